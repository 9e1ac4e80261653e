"""Variant spellings of the names of people and organisations: which rows mean the same one.

Tokens are indexed by their symmetric-delete neighbourhood: a token and each string that lacks one of its characters. Two
tokens that share an entry are compared, and the rarer one becomes a variant of the commoner one when a single edit (or
two neighbours swapped) parts them. Surnames and first words of organisations are linked that way over all rows; first
names and kinds of organisation only among those that share one, where nicknames, initials and abbreviations are resolved
too. Last, each spelling is aligned with its group's commonest full spelling by optimal assignment of tokens; what can't
be aligned leaves the group. All steps are equi-joins over distinct tokens, none collects a group.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import Cut, cut
from ..operators.skew import hot_limit, join_counted

# Common short forms of given names.
NICKNAMES = {
    "alexander": "alex sasha sandy xander al lex aleks", "alexandra": "alexa lexi", "andrew": "andy drew", "anthony": "tony", "antonio": "toni tonio", "barbara": "barb babs", "benjamin": "ben benny benji", "catherine": "cathy cath",
    "charles": "charlie chuck chas charley", "christina": "tina chrissy", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davey", "deborah": "deb debbie", "dmitri": "dima mitya", "donald": "don donnie",
    "dorothy": "dot dottie", "edward": "ed ted eddie ned teddy eddy", "elizabeth": "liz beth betty eliza lizzie bess betsy libby", "francisco": "paco pancho kiko curro", "frederick": "fred freddie", "friedrich": "fritz friedl", "gabriela": "gaby gabi gabby",
    "george": "georgie", "giuseppe": "beppe peppe pino", "gregory": "greg", "henry": "harry hank", "ivan": "vanya", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny", "jessica": "jess jessie", "johannes": "hans hannes johan",
    "john": "johnny jack", "jonathan": "jon", "joseph": "joe joey jo", "joshua": "josh", "katherine": "kate kathy kat katie kathie kitty katy", "kenneth": "ken kenny", "lawrence": "larry", "leonard": "leo lenny", "margaret": "maggie peggy meg marge greta maisie",
    "matthew": "matt", "michael": "mike mick mikey micky", "mikhail": "misha", "nicholas": "nick", "nikolai": "kolya kolja", "pamela": "pam", "patricia": "pat tricia patty trish patsy", "patrick": "paddy", "peter": "pete", "philip": "phil",
    "raymond": "ray", "rebecca": "becky", "richard": "rick dick rich ricky richie", "robert": "bob rob bobby robbie bert", "ronald": "ron ronnie", "samuel": "sam sammy", "sergei": "seryozha", "stephen": "steve", "steven": "stevie", "susan": "sue susie suzy",
    "theodore": "theo", "thomas": "tom tommy thom", "timothy": "tim timmy", "victoria": "vicky vicki tori vic vickie", "vladimir": "vova volodya", "walter": "walt", "william": "bill will billy willy liam willie", "yolanda": "yoli yola yoly",
}
# Titles before or after a name.
TITLES = frozenset("mr mrs ms miss mx dr prof professor eng ing ir sir dame lord lady herr frau hr fr mag dipl phd md msc bsc mba jr sr ii iii esq rev hon don dona sra senor senora mme mlle m.".split())
# Legal forms.
LEGAL = frozenset("co company corp corporation inc incorporated ltd limited llc llp lp plc gmbh ag kg kgaa ohg ug se sa sas sarl srl spa bv nv oy oyj ab as asa aps pty pte kk doo zrt sro ltda".split())
# Kinds of organisation, with the usual abbreviations that the rule of spelled_out() doesn't resolve.
KINDS = {
    "academy": "", "agency": "", "airlines": "", "analytics": "", "association": "assn assoc", "bank": "", "bureau": "", "center": "ctr centre", "college": "coll", "commission": "comm", "committee": "cttee", "consulting": "cons", "department": "dept", "development": "dev devt", "engineering": "engrg",
    "foundation": "", "group": "grp", "holdings": "", "hospital": "", "industries": "ind inds", "institute": "inst", "insurance": "ins", "international": "intl", "laboratories": "labs lab laboratory", "library": "lib", "logistics": "log", "manufacturing": "mfg", "ministry": "min", "museum": "mus", "networks": "", "partners": "",
    "pharmaceuticals": "pharma", "publishing": "publ", "railways": "railway rwy", "research": "res", "services": "svc", "society": "soc", "software": "sw", "solutions": "soln", "studios": "", "systems": "sys", "technologies": "tech techs", "telecom": "tel", "transport": "", "trust": "tr", "union": "un", "university": "uni",
}
FORMAL = {n: f for f, ns in NICKNAMES.items() for n in ns.split()}
GIVEN = frozenset(NICKNAMES)
KIND = {a: k for k, v in KINDS.items() for a in v.split()}
_DIGITS = str.maketrans("0135", "oles")


def fold(text: str) -> str:
    """Without marks: letters with them stand for the plain ones."""
    text = text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L").replace("æ", "ae").replace("œ", "oe").replace("đ", "d")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def digraphs(token: str) -> str:
    """ae, oe and ue as the single vowels that they may spell."""
    return re.sub(r"([aou])e", r"\1", token)


def _clean(token: str) -> str:
    return token.translate(_DIGITS) if re.search("[A-Za-z]", token) else token


@lru_cache(maxsize=200_000)
def person(name: str) -> tuple[str, str, str]:
    """(surname, first name or initial, middle initials), folded and in lower case; '' for what is missing."""
    text = re.sub(r"\([^)]*\)|[\"“”„]", " ", fold(name)).strip()
    if "," in text:
        last, _, rest = text.partition(",")
        if rest.strip().lower().strip(".") in TITLES:
            return person(last)
        words = [w for w in last.split() if w.lower().strip(".") not in TITLES]
        first = _parts(rest)
        return (" ".join(_clean(w) for w in words).lower(), first[0] if first else "", "".join(w[0] for w in first[1:]))
    m = re.fullmatch(r"([^\W\d_]{2,})[._]([^\W\d_]{2,})", text)
    if m and text == text.lower():
        return m[2], m[1], ""
    words = [w for w in re.split(r"\s+", text) if w and w.lower().strip(".") not in TITLES]
    if not words:
        return "", "", ""
    caps = [len(w) > 2 and w.isupper() and "." not in w for w in words]
    if len(words) > 1 and caps[0] and not all(caps):
        first = _parts(" ".join(words[1:]))
        return _clean(words[0]).lower(), first[0] if first else "", "".join(w[0] for w in first[1:])
    parts = _parts(" ".join(words))
    if len(parts) == 1:
        return parts[0], "", ""
    if len(parts[-1]) == 1:  # Surname F. M.
        return parts[0], parts[1], "".join(w[0] for w in parts[2:])
    return parts[-1], parts[0], "".join(w[0] for w in parts[1:-1])


def _parts(text: str) -> list[str]:
    words = [w for w in re.split(r"[\s.]+", text) if w]
    return [_clean(w).lower().strip("-'") for w in words if w.lower() not in TITLES and w.strip("-'")]


@lru_cache(maxsize=50_000)
def spelled_out(word: str) -> str:
    """The kind of organisation that a word abbreviates: the one that it begins, else the one of whose letters it is."""
    if word in KIND:
        return KIND[word]
    if word in KINDS or not 2 <= len(word) <= 6:
        return word
    fits = [k for k in KINDS if abbreviates(word, k)]
    begun = [k for k in fits if k.startswith(word)]
    return begun[0] if len(begun) == 1 else fits[0] if len(fits) == 1 else word


@lru_cache(maxsize=200_000)
def organisation(name: str) -> tuple[str, str, str]:
    """(proper part, kind, legal form); the order of "Kind of Proper" is undone, known abbreviations are spelled out."""
    text = re.sub(r"(?<=\b[A-Za-z])\.(?=[A-Za-z]\b)", "", fold(name))
    text = re.sub(r"[.,;\-/_()\"“”]+", " ", text.replace("'", "")).lower().replace("&", " and ")
    words = [_clean(w) for w in text.split()]
    if words and words[0] == "the":
        words = words[1:]
    legal = ""
    while len(words) > 1 and words[-1] in LEGAL:
        legal = words.pop()
    if "of" in words[1:-1]:
        i = words.index("of")
        words = [w for w in words[i + 1 :] if w != "the"] + words[:i]
    words = [w for w in words if w not in ("and", "of", "the")] or words
    if not words:
        return "", "", legal
    return words[0], " ".join(map(spelled_out, words[1:])), legal


# -- tokens ---------------------------------------------------------------------------------------------------------


def _neighbourhood(token: F.Column) -> F.Column:
    n = F.length(token)
    return F.array_distinct(F.concat(F.array(token), F.when(n >= 4, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, n)))).otherwise(F.array())))


def _chars(c: F.Column) -> F.Column:
    return F.array_sort(F.split(c, ""))


def _near(a: F.Column, b: F.Column) -> F.Column:
    d = F.levenshtein(a, b)
    return (d <= 1) | ((d == 2) & (F.length(a) == F.length(b)) & (_chars(a) == _chars(b)))


#: How much commoner a token under five characters must be than another such one for that to count as its misspelling.
RARER = 20


def variants(tokens: DataFrame) -> DataFrame:
    """(scope, token, centre) of each (scope, token, n) of a written table: the commonest token that a chain of small edits leads to.

    Edits count on the token as it stands and with digraphs as single vowels. Short names differ by one letter more often
    than they are misspelled, so where both have under five characters the commoner must be RARER times as common. An entry of the neighbourhood holds at most
    as many tokens as one insertion can make, so no join key is hot."""
    spark = tokens.sparkSession
    single = F.regexp_replace("token", "([aou])e", "$1")
    base = tokens.select("scope", "token", "n", single.alias("single"))
    keys = base.select("scope", "token", "n", "single", F.explode(F.array_distinct(F.concat(_neighbourhood(F.col("token")), _neighbourhood(F.col("single"))))).alias("entry"))
    other = keys.select("scope", "entry", F.col("token").alias("token2"), F.col("n").alias("n2"), F.col("single").alias("single2"))
    above = (F.col("n2") > F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("token2") < F.col("token")))
    enough = (F.greatest(F.length("token"), F.length("token2")) >= 5) | (F.col("n2") >= RARER * F.col("n"))
    both_given = F.col("token").isin(*GIVEN) & F.col("token2").isin(*GIVEN)
    pairs = keys.join(other, ["scope", "entry"]).where(above & enough & ~both_given & (_near(F.col("token"), F.col("token2")) | _near(F.col("single"), F.col("single2"))))
    best = pairs.groupBy("scope", "token").agg(F.max_by("token2", F.struct("n2", "token2")).alias("centre"))
    hold = Cut(spark, "centres")
    state = hold(base.join(best, ["scope", "token"], "left").select("scope", "token", F.coalesce("centre", "token").alias("centre")))
    while True:  # pointers lead to ever commoner tokens, so chains end; each round doubles their reach
        ahead = state.select("scope", F.col("token").alias("centre"), F.col("centre").alias("next")).where("centre <> next")
        if ahead.join(state.where("token <> centre"), ["scope", "centre"], "left_semi").isEmpty():
            return state
        state = hold(state.join(ahead, ["scope", "centre"], "left").select("scope", "token", F.coalesce("next", "centre").alias("centre")))


# -- alignment ------------------------------------------------------------------------------------------------------


def small_edit(a: str, b: str) -> bool:
    """Whether at most one edit, or one swap of neighbours, parts two tokens of five characters or more."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def abbreviates(short: str, long: str) -> bool:
    """Whether a token is an initial or drops letters of another, the first one kept."""
    if not short or len(short) >= len(long) or short[0] != long[0]:
        return False
    rest = iter(long)
    return all(c in rest for c in short)


def token_cost(a: str, b: str) -> float:
    """0 equal, up to 1 for tokens that may stand for each other, 9 for others."""
    a1, b1 = FORMAL.get(a, a), FORMAL.get(b, b)
    if a == b or a1 == b1:
        return 0.0
    if digraphs(a1) == digraphs(b1) or small_edit(a1, b1) or small_edit(digraphs(a1), digraphs(b1)) or small_edit(a, b):
        return 0.5
    if len(a) == 1 or len(b) == 1:
        return 0.6 if a1[0] == b1[0] or a[0] == b[0] else 9.0
    short, long = sorted((a, b), key=len)
    if len(short) <= 5 and abbreviates(short, long):
        return 0.7
    # two edits are within reach of a chain
    return 0.9 if min(len(a1), len(b1)) >= 6 and abs(len(a1) - len(b1)) <= 2 and _edits(digraphs(a1), digraphs(b1)) <= 2 else 9.0


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def assignment(cost: list[list[float]]) -> float:
    """Least cost of giving each row a column of its own (no more rows than columns), by shortest augmenting paths."""
    n, m = len(cost), len(cost[0])
    u, v, row_of = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, way, used = [inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while row_of[j]:
            used[j], at, delta, nxt = True, row_of[j], inf, 0
            for k in range(1, m + 1):
                if not used[k]:
                    c = cost[at - 1][k - 1] - u[at] - v[k]
                    if c < least[k]:
                        least[k], way[k] = c, j
                    if least[k] < delta:
                        delta, nxt = least[k], k
            for k in range(m + 1):
                if used[k]:
                    u[row_of[k]] += delta
                    v[k] -= delta
                else:
                    least[k] -= delta
            j = nxt
        while j:
            row_of[j] = row_of[way[j]]
            j = way[j]
    return sum(cost[row_of[k] - 1][k - 1] for k in range(1, m + 1) if row_of[k])


def alignment(a: list[str], b: list[str]) -> float:
    """Cost of the best assignment of the shorter token list to the longer one, however long; 9 or more where none fits."""
    if len(a) > len(b):
        a, b = b, a
    if not a or a == b:
        return 0.0
    return assignment([[token_cost(x, y) for y in b] for x in a])


def _aligned(df: DataFrame) -> DataFrame:
    """df(spelling, best, ...) with fits: whether the tokens of both can be aligned."""

    def run(batches):
        for b in batches:
            got = [alignment(x.split(), y.split()) < 9 if x and y else True for x, y in zip(b.column("spelling").to_pylist(), b.column("best").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], names=[*b.schema.names, "fits"])

    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", fits boolean")


@lru_cache(maxsize=200_000)
def given(part: str) -> str:
    """A given name without its short form, and without a small edit where just one common name is that near."""
    if part in GIVEN or part in FORMAL or len(part) < 5:
        return FORMAL.get(part, part)
    near = [g for g in GIVEN if small_edit(part, g)]
    return near[0] if len(near) == 1 else part


# -- rows -----------------------------------------------------------------------------------------------------------


def parsed(mentions: DataFrame, id_col: str = "mention_id") -> DataFrame:
    """(id, kind, block, part, extra) of each row of a person or organisation that has a name.

    block: surname or proper part; part: given name, initial or kind of organisation; extra: middle initials. Where a
    row's own name has only an initial or less and one of its aliases spells the part out, the alias counts."""
    kind = F.lower(F.regexp_replace("type", r"^\s+|\s+$", ""))
    rows = mentions.select(
        F.col(id_col).cast("long").alias("id"),
        F.when(kind == "person", "person").when(kind.isin("organization", "organisation"), "org").alias("kind"),
        F.coalesce("name", "canonical_name").alias("name"),
        "aliases",
    ).where("kind is not null and name is not null")

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for i, k, name, aliases in zip(*(c.to_pylist() for c in b.columns)):
                read = person if k == "person" else organisation
                got = read(name)
                if len(got[1]) < 2 and aliases:
                    near = [g for g in (read(a) for a in aliases if a) if len(g[1]) > 1 and (small_edit(digraphs(g[0]), digraphs(got[0])) or g[0] == got[0])]
                    if near and (not got[1] or near[0][1][0] == got[1][0]):
                        got = near[0]
                if not got[0]:
                    continue
                part = given(got[1]) if k == "person" else got[1]
                for column, v in zip(out, (i, k, got[0], part, got[2] if k == "person" else "")):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.string()) for x in out[1:])], names=["id", "kind", "block", "part", "extra"])

    return rows.mapInArrow(run, "id long, kind string, block string, part string, extra string")


def entities(mentions: DataFrame, id_col: str = "mention_id") -> DataFrame:
    """(id, entity) of each row of a person or organisation; equal entity: the same one.

    Rows of other types, or without any name, are left out. A form that fits several people or organisations alike (an
    initial that two share) joins none of them, only its equals. Repeated rows get the same entity."""
    rows = cut(parsed(mentions, id_col), "names")
    total = rows.count()
    few = total <= hot_limit(total)  # then no key is a hot one

    def spread(big: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
        return join_counted(big, small if few else cut(small, "counts"), on, total)

    tokens = cut(rows.groupBy(F.col("kind").alias("scope"), F.col("block").alias("token")).agg(F.count("*").alias("n")), "surnames")
    blocks = variants(tokens).join(tokens, ["scope", "token"]).select(F.col("scope").alias("kind"), F.col("token").alias("block"), F.col("centre").alias("head"), "n")
    rows = cut(spread(rows, blocks, ["kind", "block"]), "heads")
    full = (F.length("part") > 1) & ~((F.col("kind") == "org") & (F.length("part") <= 4) & ~F.col("part").isin(*KINDS))
    tokens = cut(rows.where(full).groupBy(F.concat_ws("\t", "kind", "head").alias("scope"), F.col("part").alias("token")).agg(F.count("*").alias("n")), "parts")
    parts = variants(tokens).join(tokens, ["scope", "token"]).select(F.split("scope", "\t")[0].alias("kind"), F.split("scope", "\t")[1].alias("head"), F.col("token").alias("part"), F.col("centre").alias("given"), "n")
    whole = cut(spread(rows.where(full), parts, ["kind", "head", "part"]), "whole")
    short = rows.where(~full)
    forms = short.groupBy("kind", "head", "part", "extra").agg(F.count("*").alias("n"))
    small = spread(short, _completed(forms, whole), ["kind", "head", "part", "extra"])
    small = small.withColumn("given", F.coalesce("given", F.concat_ws(".", F.lit(""), "part", "extra")))
    everyone = cut(whole.select("id", "kind", "head", "given", "block", "part").unionByName(small.select("id", "kind", "head", "given", "block", "part")), "everyone")
    spelling = F.concat_ws(" ", "part", "block")
    spelled = everyone.groupBy("kind", "head", "given", spelling.alias("spelling")).agg(F.count("*").alias("n"), F.max(F.length("part")).alias("long"))
    best = spelled.groupBy("kind", "head", "given").agg(F.max_by("spelling", F.struct((F.col("long") > 1).cast("int"), "n", "spelling")).alias("best"))
    apart = _aligned(spelled.join(best, ["kind", "head", "given"]).where("spelling <> best").select("kind", "head", "given", "spelling", "best")).where("not fits").select("kind", "head", "given", "spelling", F.lit(True).alias("apart"))
    key = ["kind", "head", "given", "spelling"]
    named = spelled.select(*key, "n").join(apart, key, "left").withColumn("entity", F.concat_ws("\t", "kind", "head", "given", F.when(F.col("apart"), F.col("spelling")))).drop("apart")
    return spread(everyone.withColumn("spelling", spelling), named, key).select("id", "entity")


def _completed(forms: DataFrame, whole: DataFrame) -> DataFrame:
    """(kind, head, part, extra, n, given): for initials, abbreviations and missing parts the one of the same head that they fit.

    Without just one that fits, given is null. What an initial or a missing part may stand for is counted per first letter
    before it is joined, so a common surname's short forms never meet all of its given names; abbreviations, which only
    kinds of organisation have, meet the kinds of one name that begin alike."""
    key = ["kind", "head", "part", "extra"]
    known = whole.groupBy("kind", "head", "given", "extra").agg(F.count("*").alias("n"))
    begins = known.select("kind", "head", "given", "extra", F.explode(F.array(F.lit(""), F.substring("given", 1, 1))).alias("part"))
    loose = begins.select("kind", "head", "part", "given").distinct().groupBy("kind", "head", "part").agg(F.count("*").alias("k"), F.min("given").alias("only"))
    tight = begins.where("extra <> ''").groupBy("kind", "head", "part", "extra").agg(F.count("*").alias("kt"), F.min("given").alias("only_t"))
    one = forms.where(F.length("part") <= 1).join(loose, ["kind", "head", "part"]).join(tight, ["kind", "head", "part", "extra"], "left")
    pick = lambda df: df.select("kind", "head", "part", "extra", F.when(F.col("kt") == 1, F.col("only_t")).when(F.col("k") == 1, F.col("only")).alias("given"))
    letters = F.concat(F.lit("^"), F.regexp_replace("part", "(.)", "$1.*"))
    fits = F.col("given").startswith(F.col("part")) | (F.col("part").rlike("^[a-z ]+$") & F.rlike(F.col("given"), letters))
    kinds = known.where("kind = 'org'").select("kind", "head", "given", F.substring("given", 1, 1).alias("letter")).distinct()
    many = forms.where((F.length("part") > 1) & (F.col("kind") == "org")).withColumn("letter", F.substring("part", 1, 1)).join(kinds, ["kind", "head", "letter"]).where(fits)
    many = many.groupBy("kind", "head", "part", "extra").agg(F.count("*").alias("k"), F.min("given").alias("only"))
    found = pick(one).unionByName(pick(many.withColumns({"kt": F.lit(None).cast("long"), "only_t": F.lit(None).cast("string")})))
    return forms.join(found, key, "left")


PAIR_BLOCK = 2000


def linked_pairs(mentions: DataFrame, id_col: str = "mention_id") -> DataFrame:
    """(id_a, id_b), a < b: each pair of rows that mean the same person or organisation.

    A group of more than PAIR_BLOCK rows is cut into hashed blocks and joined block by block, so a group with a third of
    all rows spreads over many tasks."""
    who = cut(entities(mentions, id_col).distinct(), "entities")
    big = who.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").select("entity", F.ceil(F.col("n") / PAIR_BLOCK).cast("int").alias("blocks"))
    held = who.join(big, "entity").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = held.select("entity", F.col("id").alias(f"{id_col}_a"), F.col("block").alias("i"), every.alias("j"))
    b = held.select("entity", F.col("id").alias(f"{id_col}_b"), F.col("block").alias("j"), every.alias("i"))
    return a.join(b, ["entity", "i", "j"]).where(F.col(f"{id_col}_a") < F.col(f"{id_col}_b")).select(f"{id_col}_a", f"{id_col}_b")


def groups(mentions: DataFrame, id_col: str = "mention_id") -> DataFrame:
    """(id, entity_id, n_rows): the smallest row id of each row's group and the group's size."""
    who = cut(entities(mentions, id_col).distinct(), "entities")
    return who.join(who.groupBy("entity").agg(F.min("id").alias("entity_id"), F.count("*").alias("n_rows")), "entity").select(F.col("id").alias(id_col), "entity_id", "n_rows")
