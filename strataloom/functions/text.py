"""Text functions as column expressions: no Python runs per row.

Classes of characters are spelled out in ASCII where the reference results are, so that other engines agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import refdata

BLANKS = r"[ \t\n\r\f\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(c: Column | str) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(c, f"^{BLANKS}+|{BLANKS}+$", "")


def clean_text(c: Column | str) -> Column:
    """Control characters go, runs of blanks and of line breaks shrink; null gives ''."""
    x = F.regexp_replace(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]", "")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r" *(\n+) *", "$1")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def words(c: Column | str) -> Column:
    return F.filter(F.split(c, f"{BLANKS}+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def tokenize(c: Column | str) -> Column:
    """Lower-case runs of letters, digits, _ - and . of two characters or more."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-zA-Z0-9_\-.]", " "), r" +"), lambda w: F.length(w) > 1)


def keywords(c: Column | str, stopwords: list[str] | None = None) -> Column:
    """Words of a question that say something, in order, once each."""
    stop = refdata.words(stopwords or refdata.STOPWORDS)
    w = F.split(F.regexp_replace(F.lower(c), r"[^a-zA-Z0-9_\- \t\n\r\f\x0B]", " "), r"[ \t\n\r\f\x0B]+")
    return F.array_distinct(F.filter(w, lambda x: (F.length(x) >= 2) & ~F.array_contains(stop, x)))


def roots(w: Column, wide: bool = False) -> Column:
    """The simpler forms that a word may be of: by its first ending that is listed, or by what a noun in -tion holds.
    wide: with the further forms that a search of the graph tries."""
    n, none = F.length(w), F.array().cast("array<string>")
    out = None
    for ending, least, forms, more in refdata.ENDINGS:
        stem = F.substring(w, F.lit(1), n - len(ending))
        made = F.array(*[F.concat(stem, F.lit(x)) for x in (forms + more if wide else forms)])
        hit = w.endswith(ending) & (n >= least)
        out = F.when(hit, made) if out is None else out.when(hit, made)
    held = F.array()
    for part, words_ in refdata.NOUNS.items():
        held = F.concat(held, F.when(w.contains(part) & (F.lit(True) if wide else F.size(held) == 0), refdata.words(words_)).otherwise(none))
    return out.when(w.endswith("tion") & (n > 5), held).otherwise(none)


def expand_terms(terms: Column) -> Column:
    """Terms followed by their simpler forms, once each."""
    return F.array_distinct(F.concat(terms, F.flatten(F.transform(terms, lambda x: roots(x)))))


def estimate_tokens(c: Column | str) -> Column:
    n = F.length(c)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("int")


def title_case(c: Column | str) -> Column:
    """Each run of letters with a capital first, the rest small."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def clean_name(c: Column | str) -> Column:
    """Without quotes and blanks around, single blanks inside."""
    x = F.regexp_replace(c, r"^[\s\"'`\x{201C}\x{2018}]+|[\s\"'`\x{201D}\x{2019}]+$", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def canonical_name(c: Column | str, table: dict[str, str] | None = None) -> Column:
    """A known name's one spelling, else the name, in title case where it is all small and longer than two."""
    x = clean_name(c)
    small = (x == F.lower(x)) & x.rlike("[a-z]") & (F.length(x) > 2)
    return F.coalesce(refdata.lookup(table or refdata.CANONICAL_NAMES, F.lower(x)), F.when(small, title_case(x)).otherwise(x))


def canonical_library(c: Column | str) -> Column:
    x = F.replace(F.lower(clean_name(c)), F.lit("_"), F.lit("-"))
    return F.coalesce(refdata.lookup(refdata.CANONICAL_LIBRARIES, x), x)


def relationship_type(c: Column | str) -> Column:
    """Upper snake case; what has less than two characters is RELATED_TO."""
    x = F.upper(F.regexp_replace(F.trim(c), r"[^a-zA-Z0-9_]", "_"))
    x = F.regexp_replace(F.regexp_replace(x, "_+", "_"), "^_+|_+$", "")
    return F.when(F.length(x) > 1, x).otherwise("RELATED_TO")


def label(c: Column | str, default: str = "Concept") -> Column:
    """A name that a vertex or edge label may have."""
    x = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_]", "_"), "_+", "_")
    x = F.regexp_replace(x, "^_+|_+$", "")
    return F.when(F.coalesce(F.length(x), F.lit(0)) == 0, default).otherwise(x)


def one_line(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(c, r"[\r\n]", " "))


def truncate(c: Column | str, n: int, dots: bool = False) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..." if dots else ""))).otherwise(c)


def snippet(text: Column, needle: Column, around: int) -> Column:
    """The first place of needle with so many characters on either side."""
    at = F.position(needle, text)
    first = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, strip(F.substring(text, first, at - first + F.length(needle) + around)))


def line_count(c: Column | str) -> Column:
    """Lines as an editor counts them: a last line break begins no further line."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return F.when(F.length(c) == 0, 0).otherwise(n + F.when(c.endswith("\n"), 0).otherwise(1)).cast("int")


def line_of(text: Column, at: Column) -> Column:
    """1-based line of a 1-based position."""
    return F.size(F.split(F.substring(text, F.lit(1), at - 1), "\n")).cast("int")


def text_or(*cs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))


def intent(c: Column | str) -> Column:
    """The intent with most matches, each pattern counted on its own, the first of equals; general without any."""
    q = F.lower(c)
    scores = F.array(*(F.struct(sum((F.size(F.regexp_extract_all(q, F.lit(p), F.lit(0))) for p in ps), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, ps) in enumerate(refdata.INTENTS.items())))
    best = F.array_max(scores)
    return F.when(best["n"] > 0, best["name"]).otherwise("general")


def question_entities(c: Column | str) -> Column:
    """Quoted phrases, camel-case names, capitalised phrases and acronyms of a question, once each."""
    stop = refdata.words(refdata.STOPWORDS)
    quoted = F.filter(F.transform(F.regexp_extract_all(c, F.lit("[\"']([^\"']+)[\"']"), F.lit(1)), F.trim), lambda x: x != "")
    camel = F.filter(F.regexp_extract_all(c, F.lit(r"\b[A-Z][a-zA-Z0-9]+(?:[A-Z][a-zA-Z0-9]+)+\b"), F.lit(0)), lambda x: F.length(x) > 3)
    phrases = F.regexp_extract_all(c, F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"), F.lit(0))
    acronyms = F.filter(F.regexp_extract_all(c, F.lit(r"\b[A-Z]{2,6}\b"), F.lit(0)), lambda x: ~F.array_contains(stop, F.lower(x)))
    return F.array_distinct(F.concat(quoted, camel, phrases, acronyms))


def question_targets(c: Column | str) -> Column:
    """File names, called functions and snake-case names of a question, once each."""
    files = F.regexp_extract_all(c, F.lit(r"(?i)\b[\w\-/\\]+\.(?:py|js|json|md|pdf|xlsx|xls|csv|tsv|parquet|html|xml|yaml|yml)\b"), F.lit(0))
    calls = F.transform(F.regexp_extract_all(c, F.lit(r"\b[a-zA-Z_][a-zA-Z0-9_]{2,}\(\)"), F.lit(0)), lambda x: F.regexp_replace(x, r"[()]+$", ""))
    snake = F.regexp_extract_all(c, F.lit(r"\b[a-z]+(?:_[a-z0-9]+)+\b"), F.lit(0))
    stop = refdata.words(refdata.STOPWORDS)
    return F.array_distinct(F.concat(files, F.filter(F.concat(calls, snake), lambda x: ~F.array_contains(stop, F.lower(x)))))


def graph_terms(entities: Column, targets: Column, keywords_: Column, intent_: Column) -> Column:
    """What a search of the graph looks for: a question's entities, targets and keywords as they stand and in lower case,
    their simpler forms, and the words that its intent adds; of two characters or more, once each, sorted."""
    said = F.filter(F.transform(F.concat(entities, targets, keywords_), strip), lambda x: F.length(x) >= 2)
    low = F.transform(said, F.lower)
    more = F.coalesce(refdata.lookup(refdata.INTENT_TOKENS, intent_), F.lit(""))
    every = F.concat(said, low, F.flatten(F.transform(low, lambda x: roots(x, wide=True))), F.split(more, " "))
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: F.length(x) >= 2)))


def human_size(c: Column | str) -> Column:
    """A number of bytes as KB or MB."""
    kb = F.coalesce(F.greatest(F.col(c) if isinstance(c, str) else c, F.lit(0)), F.lit(0)) / 1024.0
    return F.when(kb >= 1024, F.concat(F.format_string("%.2f", kb / 1024.0), F.lit(" MB"))).when(kb > 0, F.concat(F.format_string("%.1f", kb), F.lit(" KB"))).otherwise("0 KB")


def status_group(c: Column | str) -> Column:
    """A status as a view tells it: COMPLETED, PROCESSING, FAILED, UPLOADED, else PENDING."""
    s = F.upper(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return F.when(s.contains("COMPLETED"), "COMPLETED").when(s.rlike("PROCESSING|RUNNING"), "PROCESSING").when(s.rlike("FAILED|ERROR"), "FAILED").when(s.contains("UPLOADED"), "UPLOADED").otherwise("PENDING")


def target_file(targets: Column) -> Column:
    """The first of a question's targets that is a file's name."""
    return F.try_element_at(F.filter(targets, lambda x: x.rlike(r"\.(?:py|js|json|md|pdf|xlsx|csv)$")), F.lit(1))
