"""Template residue and error pages: documents that hold placeholders, filler, an error or a notice for their content.

A regularised linear classifier over hashed words and pairs of words, size and title scores every document, and every row
of the result comes from it. It is fitted on a bounded sample (SAMPLE rows at most, chosen by a hash of the id) whose weak
labels come from response statuses and phrases, told line by line: a document that is nearly all residue teaches one
class, one that holds none the other. No feature says what the phrases found. From SURE on the score alone decides;
between DOUBT and SURE an exact check of the lines follows; below DOUBT nothing counts, whatever phrases a text holds.
validation() measures it on repositories that it hasn't seen, also for kinds of residue that its labels left out.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the labelled sample, at most; the classifier's features; its penalty and rounds; of the negatives, one in so many teaches.
SAMPLE, BITS, PENALTY, ROUNDS, THIN = 12_000, 15, 2e-4, 60, 4
#: Scores from which a document is checked, and from which it counts without a check.
DOUBT, SURE = 0.2, 0.8
#: Residue's share of what a document holds besides its skeleton, at least (the exact check).
LEAST_SHARE = 0.33
KINDS = ("placeholder", "filler", "scripts", "error")

# Words of the usual filler text.
FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vel augue nunc felis quam lectus massa porta tempus cursus ornare vestibulum mauris donec "
    "pellentesque tincidunt fermentum vitae orci sapien risus ligula nibh turpis egestas viverra justo feugiat pretium praesent integer suspendisse phasellus".split()
)
# Reasons of HTTP statuses, and the phrases of error pages and notices in several languages.
REASONS = (
    "bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|request time-?out|conflict|gone|payload too large|too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|"
    "access (?:is )?denied|permission denied|rate limit(?:ed)?(?: exceeded)?|connection (?:timed out|refused|reset)|origin (?:is unreachable|dns error)|unknown error|server error|forbidden request"
)
ERRORS = re.compile(
    rf"(?i)\b(?:(?:http|error|fehler|erreur|c[oó]digo|ошибка|status)\W{{0,3}}(?:code\W{{0,3}})?[45]\d\d\b|[45]\d\d\W{{1,4}}(?:{REASONS})|(?:{REASONS}))"
    r"|(?i:could not (?:handle|be served|be found|be loaded|complete)|couldn'?t find|cannot be (?:found|displayed)|can'?t be reached|page (?:you|was|is|does|has|cannot|could)|request was blocked|has been blocked|was (?:blocked|denied|rejected)|something went wrong|an error (?:has )?occurred|try again later|(?:down|closed|offline) for (?:\w+ )?maintenance|under maintenance|temporarily (?:down|unavailable|offline)|(?:quota|limit) exceeded|"
    r"wurde nicht gefunden|nicht verf[üu]gbar|zugriff verweigert|ein fehler ist aufgetreten|page (?:introuvable|non trouv[ée]e)|acc[eè]s (?:refus|interdit)|une erreur (?:est survenue|s'est)|indisponible|no (?:se )?(?:ha )?(?:encontr|pudo|existe)|p[aá]gina no|acceso denegado|no disponible|"
    r"pagina non trovata|accesso negato|страница не найдена|доступ запрещ|не найден|ошибка сервера|ページが見つかり|アクセスが拒否|页面不存在|未找到|访问被拒绝)"
)
SCRIPTS = re.compile(
    r"(?i)(?:(?:enable|turn on|activate|requires?|need|allow|without)\b[^.\n]{0,40}\b(?:javascript|js|scripts?|scripting|cookies)\b|\b(?:javascript|scripts?|cookies)\b[^.\n]{0,30}(?:(?:is|are|must be|seems?|appears?)[^.\n]{0,12}(?:required|disabled|enabled|needed|off|activ)|est (?:requis|d[ée]sactiv|n[ée]cessaire)|aktivieren|erforderlich|deaktiviert)|"
    r"aktivieren sie[^.\n]{0,20}javascript|activez? javascript|(?:habilit|activ)[ea]r?\w*[^.\n]{0,20}javascript|javascript[^.\n]{0,30}(?:requerid|necesari|habilit|abilit|richiest)|abilita[^.\n]{0,20}javascript|включите javascript|javascript[^.\n]{0,20}(?:отключ|включ|необходим)|javascriptを有効|启用\s*javascript|"
    r"checking your browser|verify (?:that )?you are (?:a )?human|complete the captcha|ddos protection)"
)
PLACEHOLDER = re.compile(
    r"\{\{\s*[\w.\- ]{1,40}\s*\}\}|\{%\s*[\w.\- ]{1,40}\s*%\}|<%=?\s*[\w.\- ]{1,40}\s*%>|%%\s*[\w\- ]{2,40}\s*%%|\$\{?(?:PROJECT|PACKAGE|AUTHOR|TITLE|SUMMARY|DESCRIPTION|REPO|APP|ORG|USER|COMPANY|MODULE|YOUR)_\w+\}?|\{(?:PROJECT|PACKAGE|AUTHOR|TITLE|YOUR)_\w+\}|"
    r"(?<![\w$])\$[a-z][a-z_]{2,30}\$(?!\w)|__[A-Z][A-Z_]*_?PLACEHOLDER__|__(?:YOUR|INSERT|REPLACE|FILL|CHANGE)_?[A-Z_]*__|@@[A-Z_]{2,40}@@|##[A-Z_]{3,40}##|\b(?:FIXME|TODO|CHANGEME|REPLACE|YOUR|INSERT)_[A-Z][A-Z_]*\b|\bCHANGE_?ME\b|"
    r"(?i:[\[<({](?:your|insert|add|enter|put|replace|fill in|todo|tbd|name of|describe)\b[^\]>)}\n]{1,60}[\]>)}])|(?i:\b(?:todo|fixme|tbd)\b\s*[:\-]?\s*(?:describe|write|add|fill|insert|document|complete|replace|explain|provide|update|put)\b[^\"'\n<]{0,60})|"
    r"(?i:\b(?:insert|write|add|put|your) [\w ]{2,30} (?:here|goes here)\b|\b(?:text|content|description|title|documentation) (?:goes here|to be (?:added|written|done|provided)|coming soon)|this (?:section|page|file|document) (?:is|has been) (?:intentionally )?(?:left blank|empty|under construction|a stub|a placeholder)|\bcoming soon\b|\bunder construction\b)"
)
_TAG = re.compile(r"<[^<>]{1,400}>|<!--.*?-->")
_SKELETON = re.compile(
    r"^(?:#{1,6}\s.*|[\W_]*|```.*|\[[\w.\-]+\]|(?:def|func|function|class|fn|public|private|static|void|package|module|namespace|export|import|return|pass|end|begin|main|int|from|require|use|using|var|let|const)\b[\w\s(){};:.,=*\"'/]{0,40}|"
    r"[\"']?(?:version|code|status|request_?id|reference|trace_?id|ray_?id|timestamp|path|id|license|type|private|error|errors|message|reason|title|detail|details|instance|name|description|author|authors)[\"']?\s*[:=]\s*[\[{(\"']*[\w.\-:/]{0,40}[\]})\"',]*|(?:pip|npm|yarn|go|cargo|brew|apt|gem) [\w\-]+( [\w\-]+)?|[A-Za-z ]{0,24}:)$"
)
_WORD = re.compile(r"[^\W\d_]+|\d+|[{}<>\[\]$%@#=:;()]")
_NOT_WORD = re.compile(r"[\W\d_]+")


# What residue of each kind contains, in lower case.
ANCHORS = {
    1: "{{|{%|<%|%%|@@|##|{project_|{package_|{author_|{title_|{your_|$project_|$package_|$author_|$title_|$summary_|$description_|$repo_|$app_|$org_|$user_|$company_|$module_|$your_|${project_|${package_|${author_|${title_|${summary_|${description_|${repo_|${app_|${org_|${user_|${company_|${module_|${your_|"
    "placeholder__|__your|__insert|__replace|__fill|__change|fixme|todo|tbd|changeme|change_me|replace|insert|your|goes here|coming soon|under construction|left blank|is empty|a stub|[enter|<enter|{enter|(enter|[put|<put|{put|(put|[fill|<fill|{fill|(fill|[name of|<name of|{name of|(name of|[describe|<describe|{describe|(describe|"
    "[add |<add |{add |(add |write |to be added|to be written|to be done|to be provided",
    2: "bad request|unauthorized|payment required|forbidden|not found|not allowed|not acceptable|time-out|timeout|conflict|gone|too large|too many requests|server error|not implemented|bad gateway|unavailable|denied|rate limit|timed out|refused|reset|unreachable|dns error|unknown error|http|error|fehler|erreur|codigo|código|ошибка|status|"
    "could not|couldn|cannot be|can't be|page you|page was|page is|page does|page has|page cannot|page could|blocked|rejected|went wrong|wurde nicht|verfügbar|verfugbar|zugriff|page introuvable|page non trouv|accès|acces|indisponible|encontr|existe|no pudo|no se pudo|pagina|página|disponible|accesso|страница|доступ|не найден|ページ|アクセス|页面|未找到|访问",
    4: "javascript|scripts|scripting|cookies|enable js|checking your|verify|captcha|ddos",
    8: "lorem|ipsum|dolor|amet|consectet|adipisc|elit",
}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a, of = ahocorasick.Automaton(), {}
    for kind, words in ANCHORS.items():
        for w in words.split("|"):
            of[w] = of.get(w, 0) | kind
    for w, kinds in of.items():
        a.add_word(w, kinds)
    a.make_automaton()
    return a


_DOLLARS = re.compile(r"(?<![\w$])\$[a-z][a-z_]{2,30}\$")


def _families(text: str) -> int:
    found = 0
    for _, kinds in automaton().iter(text.lower()):
        found |= kinds
    return found | (1 if "$" in text and _DOLLARS.search(text) else 0)


def _residue_kind(part: str, families: int) -> str | None:
    """What residue a line or sentence is, if it is any."""
    size = len(part)
    if families & 1:
        left, n = PLACEHOLDER.subn(" ", part)
        if n and len(_NOT_WORD.sub("", left)) <= max(16, 0.5 * (size - len(left) + n)):
            return "placeholder"
    if families & 8:
        words = [w for w in _NOT_WORD.split(part.lower()) if w]
        if len(words) >= 4 and sum(w in FILLER for w in words) >= 0.7 * len(words) and not re.search(r"[=(]\s*[\"'`]", part):
            return "filler"
    if families & 6:
        if families & 4 and (m := SCRIPTS.search(part)) and (m.end() - m.start()) * 4 >= size - 8 and not re.search(r"[=(){};]\s*[\"'`]|[\"'`]\s*[:;),]", part):
            return "scripts"
        if families & 2 and ERRORS.search(part) and (size < 240 or len(_NOT_WORD.sub("", part)) >= 0.5 * size) and _error_line(part):
            return "error"
    return None


def _parts(text: str):
    """Lines without markup, long ones by sentence; None for a line of markup alone."""
    for line in text.splitlines():
        line = line.strip()
        if line:
            plain = _TAG.sub(" ", line).strip() if "<" in line and ">" in line and not PLACEHOLDER.search(line) else line
            yield from (re.split(r"(?<=[.!?])\s+", plain) if len(plain) > 160 else (plain,))


def shares(text: str) -> tuple[int, int, int, set[str]]:
    """(residue, own, skeleton) in characters, and the kinds of residue, line by line.

    Of a text without any residue only its length is told."""
    if not _families(text) or not any((f := _families(line)) and any((g := _families(p)) and _residue_kind(p, g) for p in _parts(line)) for line in text.splitlines()):
        return 0, len(text), 0, set()
    residue = own = skeleton = 0
    kinds: set[str] = set()
    for part in _parts(text):
        if not part:
            skeleton += 1
        elif (f := _families(part)) and (kind := _residue_kind(part, f)):
            residue += len(part)
            kinds.add(kind)
        elif _SKELETON.match(part):
            skeleton += len(part)
        else:
            own += len(part)
    return residue, own, skeleton, kinds


def _error_line(part: str) -> bool:
    """Whether a line is an error's text and no statement or sentence about one."""
    left = len(_NOT_WORD.sub("", ERRORS.sub(" ", part)))
    code = re.search(r"[=(]\s*[\"'`]|[{;]\s*$|^\s*(?:return|raise|throw|if|case|except|catch|expect|assert|res|log|print|//|\*|--|def|func|const|let|var)\b|\w\(", part)
    about = re.search(r"(?i)\b(?:means|when|if|returns?|raises?|throws?|handle[sd]?|check|indicates?|occurs when|happens|troubleshoot|see)\b", ERRORS.sub(" ", part))
    return left <= 70 and not code and not about


@lru_cache(maxsize=1 << 17)
def _hash(name: str) -> int:
    return zlib.crc32(name.encode())


def grams(text: str) -> np.ndarray:
    """Indices of hashed words, pairs of words, size and title, whatever the phrases say of the text."""
    words = np.fromiter(map(_hash, _WORD.findall(text.lower())), np.uint32)
    names = [f"size:{int(np.log2(len(text) + 1))}", f"lines:{int(np.log2(text.count(chr(10)) + 1))}"]
    title = re.search(r"<title>([^<]*)|^#+ (.*)$|^(.+)$", text, re.M)
    if title:
        names += [f"title:{w}" for w in _WORD.findall(next(g for g in title.groups() if g is not None).lower()[:80])]
    pairs = (words[:-1] * np.uint32(2654435761) ^ words[1:] * np.uint32(2246822519)) >> np.uint32(32 - BITS)
    has = np.zeros(1 << BITS, bool)
    has[words & np.uint32((1 << BITS) - 1)] = has[pairs] = True
    has[[zlib.crc32(n.encode()) & ((1 << BITS) - 1) for n in names]] = True
    return np.flatnonzero(has).astype(np.uint16)


def weak_label(found: tuple[int, int, int, set[str]]) -> int | None:
    """1 or 0 where phrases and statuses settle it, None in between."""
    residue, own, _, kinds = found
    if not kinds:
        return 0
    share = residue / (residue + own)
    return 1 if share >= 0.75 else 0 if share <= 0.12 else None


def fit(rows: list[np.ndarray], labels: list[int]) -> np.ndarray:
    """Weights of a logistic regression with an L2 penalty, the last one the intercept; both classes weigh alike."""
    size = (1 << BITS) + 1
    if not rows or len(set(labels)) < 2:
        w = np.zeros(size)
        w[-1] = -1.0 if not labels or not labels[0] else 1.0
        return w
    counts = np.array([len(r) for r in rows])
    at, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), counts)
    y = np.array(labels, float)
    scale = 1 / np.sqrt(np.maximum(counts, 1))
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, step, fast = np.zeros(size), 4.0, np.zeros(size)
    for k in range(ROUNDS):  # accelerated gradient descent
        z = np.bincount(row, fast[at], len(rows)) * scale + fast[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(at, (g * scale)[row], size) + PENALTY * fast
        grad[-1] = g.sum()
        new = fast - step * grad
        fast = new + k / (k + 3) * (new - w)
        w = new
    return w


def score(text: str, w: np.ndarray) -> float:
    at = grams(text)
    return float(1 / (1 + np.exp(-np.clip(w[at].sum() / np.sqrt(len(at)) + w[-1], -30, 30))))


def checked(found: tuple[int, int, int, set[str]]) -> bool:
    """The exact check: whether residue is enough of what a text holds besides its skeleton."""
    return bool(found[3]) and found[0] >= LEAST_SHARE * (found[0] + found[1])


def labelled(docs: DataFrame, id_col: str, text_col: str, host_col: str, most: int = SAMPLE) -> DataFrame:
    """(id, host, label, kinds, words) of a hashed sample of documents that phrases and statuses settle.

    words holds the indices of grams() as bytes; one in THIN of the negatives is kept."""
    n = docs.count()
    share = min(1.0, 0.9 * most / max(n, 1))  # so the limit hardly ever binds and the sample is the same in every run
    picked = docs.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else docs

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for i, host, text in zip(*(c.to_pylist() for c in b.columns)):
                if text and (y := weak_label(found := shares(text))) is not None and (y or zlib.crc32(str(i).encode()) % THIN == 0):
                    for column, v in zip(out, (i, host, y, sorted(found[3]), grams(text).tobytes())):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.string())), pa.array(out[4], pa.binary())], names=["id", "host", "label", "kinds", "words"])

    return picked.select(F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text")).mapInArrow(run, "id long, host string, label int, kinds array<string>, words binary").limit(most)


def _sample(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> list:
    return sorted(labelled(docs, id_col, text_col, host_col).collect(), key=lambda r: (r.id, r.words))  # at most SAMPLE rows


def _taught(rows: list) -> np.ndarray:
    return fit([np.frombuffer(r.words, np.uint16) for r in rows], [r.label for r in rows])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "repository_name") -> np.ndarray:
    """Weights of the classifier: 2**BITS + 1 numbers, the intercept last."""
    return _taught(_sample(docs, id_col, text_col, host_col))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "repository_name", every: bool = False) -> DataFrame:
    """(id, score, kinds, passed, found) of each document that scores DOUBT or more; ``every``: of each that has a text.

    passed: whether the exact check would take it (null where it wasn't made); found: whether the document counts. Null,
    empty and blank texts are left out. Rows with repeated ids are judged each; other columns are ignored."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    weights = spark.sparkContext.broadcast(train(docs, id_col, text_col, host_col).astype(np.float32))  # 2**BITS + 1 numbers, whatever the input

    def run(batches):
        w = weights.value
        for b in batches:
            keep, scores, kinds, passed, found = [], [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                if not text or not text.strip():
                    continue
                p = score(text, w)
                if p < DOUBT and not every:
                    continue
                told = shares(text) if p < SURE or every else None
                ok = None if told is None else checked(told)
                keep.append(k), scores.append(round(p, 4)), passed.append(ok), found.append(p >= SURE or (p >= DOUBT and bool(ok)))
                kinds.append(sorted(told[3] if told else shares(text)[3]) or ["words"])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int32())), pa.array(scores, pa.float64()), pa.array(kinds, pa.list_(pa.string())), pa.array(passed, pa.bool_()), pa.array(found, pa.bool_())], names=[id_col, "score", "kinds", "passed", "found"])

    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double, kinds array<string>, passed boolean, found boolean")


def residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "repository_name") -> DataFrame:
    """(id, score, kinds) of each document that is template residue, filler, an error page or a notice; see judged()."""
    return judged(docs, id_col, text_col, host_col).where("found").select(id_col, "score", "kinds")


def without_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "repository_name") -> DataFrame:
    """The documents that remain."""
    return docs.join(residue(docs, id_col, text_col, host_col).select(id_col), id_col, "left_anti")


def effects(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "repository_name") -> DataFrame:
    """(score, passed, found, n): what the classifier adds to the exact check alone and what it takes away.

    score is sure, doubtful or low; (sure, not passed) are added, (low, passed) are taken away."""
    band = F.when(F.col("score") >= SURE, "sure").when(F.col("score") >= DOUBT, "doubtful").otherwise("low")
    return judged(docs, id_col, text_col, host_col, every=True).groupBy(band.alias("score"), "passed", "found").agg(F.count("*").alias("n"))


def validation(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "repository_name") -> DataFrame:
    """(left_out, rows, positives, accuracy, precision, recall) on the sample's repositories that the classifier hasn't seen.

    Every fifth repository by hash is unseen. left_out null: labels of all kinds teach. Else the classifier learns from
    labels without that kind of residue, and recall is measured on documents that are of that kind alone, so its own
    gate can't have told it. The score that counts as found is DOUBT, from which a document is looked at."""
    rows = _sample(docs, id_col, text_col, host_col)
    unseen = [zlib.crc32((r.host or "").encode()) % 5 == 0 for r in rows]
    out = []
    for kind in (None, *KINDS):
        w = _taught([r for r, u in zip(rows, unseen) if not u and (kind is None or kind not in r.kinds)])
        told = []
        for r, u in zip(rows, unseen):
            if u and (kind is None or not r.label or r.kinds == [kind]):
                at = np.frombuffer(r.words, np.uint16)
                told.append((r.label, int(1 / (1 + np.exp(-np.clip(w[at].sum() / np.sqrt(len(at)) + w[-1], -30, 30))) >= DOUBT)))
        hit, said, true = sum(a & b for a, b in told), sum(b for _, b in told), sum(a for a, _ in told)
        out.append((kind, len(told), true, sum(a == b for a, b in told) / max(1, len(told)), hit / max(1, said), hit / max(1, true)))
    return docs.sparkSession.createDataFrame(out, "left_out string, rows long, positives long, accuracy double, precision double, recall double")
