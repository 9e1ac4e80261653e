"""Queries on documents and pages: hashes, formats, cleaning, pages, chunks, inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity, text
from ..operators import chunking
from ..sources import formats


def _docs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet")


def _named(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select(F.col("doc_id").cast("string").alias("document_id"), F.col("file_path").alias("document_name"), "text")


def _pages(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/extracted_pages.parquet").select("document_id", "document_name", "page_number", "text").distinct()


def dedup_sha256(s: SparkSession, d: str) -> DataFrame:
    """The first document of each content, and how many have it."""
    docs = _docs(s, d).where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return docs.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


def canonical_pick(s: SparkSession, d: str) -> DataFrame:
    """Per content the row to keep: one with a license first, then the newest, then the smallest id."""
    docs = _docs(s, d).where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"), F.col("license_file").isNotNull().cast("int").alias("known"), "ingested_at")
    w = Window.partitionBy("sha256").orderBy(F.desc("known"), F.desc("ingested_at"), "doc_id")
    return docs.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("sha256", "doc_id")


def catalog(s: SparkSession, d: str) -> DataFrame:
    """Documents with id from content, format and size."""
    fmt = formats.detect("file_path")
    return _docs(s, d).select(
        "doc_id",
        F.when(F.col("text").isNotNull(), identity.document_id("text")).alias("document_id"),
        F.coalesce(F.sha2("text", 256), F.lit("unknown_legacy")).alias("sha256"),
        fmt.alias("format"),
        formats.category(fmt).alias("category"),
        F.coalesce(F.octet_length("text"), F.lit(0)).alias("size_bytes"),
    )


def columns_of(s: SparkSession, d: str) -> DataFrame:
    """Inferred types of a table read as text."""
    t = s.read.parquet(f"{d}/customer.parquet")
    return formats.infer_types(t.select(*[F.col(c).cast("string").alias(c) for c in t.columns]))


def json_keys(s: SparkSession, d: str) -> DataFrame:
    """Keys of the JSON of events, with how often they occur."""
    keys = s.read.parquet(f"{d}/events.parquet").select(F.explode(F.json_object_keys("props")).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n"))


def segments(s: SparkSession, d: str) -> DataFrame:
    """Segments of pages of ten characters or more."""
    parts = F.filter(F.transform(F.split("text", r"[.?!;]+|\n\n+"), text.strip), lambda x: F.length(x) >= 10)
    return _pages(s, d).select("document_id", "page_number", F.explode(parts).alias("segment")).groupBy("document_id", "page_number").agg(F.count("*").alias("n_segments"), F.sum(F.length("segment")).alias("n_chars"))


def directory_inventory(s: SparkSession, d: str) -> DataFrame:
    lang, kind, test = formats.classify("file_path")
    one = _docs(s, d).select("repository_name", lang.alias("language"), test.alias("is_test"))
    return one.groupBy("repository_name", "language").agg(F.count("*").alias("n_files"), F.count_if("is_test").alias("n_tests"))


QUERIES = {
    "dedup_sha256": dedup_sha256,
    "canonical_pick": canonical_pick,
    "catalog": catalog,
    "clean_text": lambda s, d: _docs(s, d).select("doc_id", F.md5(text.clean_text("text")).alias("md5")),
    "word_counts": lambda s, d: _pages(s, d).where("text is not null").select("document_id", "page_number", F.length("text").alias("char_count"), text.word_count("text").cast("int").alias("word_count")),
    "page_totals": lambda s, d: chunking.totals(_pages(s, d).where("text is not null")),
    "html_text": lambda s, d: _docs(s, d).where(F.lower("text").contains("<html")).select("doc_id", formats.html_text("text").alias("plain"), formats.html_title("text").alias("title")),
    "detect_format": lambda s, d: _docs(s, d).groupBy(F.coalesce(formats.detect("file_path"), F.lit("unknown")).alias("format")).agg(F.count("*").alias("n")),
    "infer_types": columns_of,
    "json_keys": json_keys,
    "tokens": lambda s, d: _pages(s, d).select(F.explode(text.tokenize("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n")),
    "token_estimate": lambda s, d: _docs(s, d).select("doc_id", text.estimate_tokens("text").alias("tokens")),
    "line_counts": lambda s, d: _docs(s, d).where("text is not null").select("doc_id", text.line_count("text").alias("lines")),
    "sql_statements": lambda s, d: _docs(s, d).where(F.col("file_path").endswith(".sql") & F.col("text").isNotNull()).select("doc_id", formats.sql_statements("text").alias("n_statements")),
    "paginate": lambda s, d: chunking.pages(_named(s, d)).select("document_id", "page_number", "char_count", "word_count", F.md5("text").alias("md5")),
    "chunk_pages": lambda s, d: chunking.chunks(_pages(s, d)).select("document_id", "page_number", "chunk_id", "char_count", F.md5("text").alias("md5")),
    "chunk_index": lambda s, d: chunking.chunks(_pages(s, d)).select("document_id", "chunk_id", "chunk_index"),
    "segments": segments,
    "classify_files": lambda s, d: formats.inventory(_docs(s, d)),
    "directory_inventory": directory_inventory,
    "url_parts": lambda s, d: _docs(s, d).select("repository_url").distinct().select("repository_url", identity.url_owner("repository_url").alias("owner"), identity.url_repo("repository_url").alias("repo")),
}

_B = r"[ \t\n\r\f\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = lambda x: f"regexp_replace({x}, '^{_B}+|{_B}+$', '', 'g')"
_CLEAN = _STRIP(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g'), '[ \t]+', ' ', 'g'), ' *(\n+) *', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
_WORDS = f"len(list_filter(regexp_split_to_array(text, '{_B}+'), lambda w: w <> ''))"
_PAGES = "pages as (select distinct document_id, document_name, page_number, text from extracted_pages)"
_EXT = "(values " + ", ".join(f"('{x}', '{f}', '{c}')" for f, c, _, x in __import__("strataloom.functions.refdata", fromlist=["x"]).FORMAT_ROWS) + ") as ext(x, format, category)"


def _language_sql() -> str:
    from ..functions import refdata

    names = ", ".join(f"('{k}', '{v[0]}', '{v[1]}')" for k, v in refdata.LANGUAGE_BY_NAME.items())
    exts = ", ".join(f"('{k}', '{v[0]}', '{v[1]}')" for k, v in refdata.LANGUAGE_BY_EXTENSION.items())
    return f"""
with f as (select *, lower(replace(file_path, '\\', '/')) as p from documents),
g as (select *, regexp_extract(p, '([^/]*)$', 1) as base from f),
h as (select *, regexp_extract(base, '.(\\.[^.]+)$', 1) as ext from g),
c as (select h.*, case when n.k is not null then n.l when base like 'dockerfile%' then 'Dockerfile' when base like '%docker-compose%' or base like '%compose.%' then 'DockerCompose' when base like 'requirements%' and ext = '.txt' then 'Requirements' else coalesce(e.l, 'Unknown') end as language,
  case when n.k is not null then n.t when base like 'dockerfile%' then 'DOCKER' when base like '%docker-compose%' or base like '%compose.%' then 'DOCKER' when base like 'requirements%' and ext = '.txt' then 'CONFIG' else coalesce(e.t, 'OTHER') end as file_type,
  (starts_with(base, 'test_') or regexp_matches(base, '(_test\\.py|\\.(test|spec)\\.(js|ts))$') or contains('/' || p, '/tests/') or contains('/' || p, '/test/')) as test
  from h left join (values {names}) as n(k, l, t) on base = n.k left join (values {exts}) as e(k, l, t) on ext = e.k)
"""


#: The last sentences of the open chunk that stay under the overlap.
_TAIL = "list_reduce(list_reverse(a.cur), lambda b, s: case when b.full or b.n + length(s) >= 150 then {'keep': b.keep, 'n': b.n, 'full': true} else {'keep': list_prepend(s, b.keep), 'n': b.n + length(s), 'full': false} end, {'keep': []::varchar[], 'n': 0::bigint, 'full': false})"
_FOLD_CHUNKS = rf"""
with {_PAGES}, live as (select * from pages where text is not null and {_STRIP('text')} <> ''),
split as (select document_id, page_number, text, list_filter(regexp_split_to_array(regexp_replace(text, '([.?!;:\n]){_B}+', concat('\1', chr(1)), 'g'), chr(1)), lambda s: s <> '') as ss from live),
fold as (select document_id, page_number, text, list_reduce(ss, lambda a, x: case when a.n + length(x) > 800 and len(a.cur) > 0
  then {{'ch': list_append(a.ch, array_to_string(a.cur, ' ')), 'cur': list_append({_TAIL}.keep, x), 'n': {_TAIL}.n + length(x)}}
  else {{'ch': a.ch, 'cur': list_append(a.cur, x), 'n': a.n + length(x)}} end, {{'ch': []::varchar[], 'cur': []::varchar[], 'n': 0::bigint}}) as v from split),
folded as (select document_id, page_number, case when length(text) <= 800 then [text] else list_append(v.ch, array_to_string(v.cur, ' ')) end as cs from fold)
"""

ORACLE = {
    "dedup_sha256": "select sha256(text) as sha256, min(doc_id) as doc_id, count(*) as n_copies from documents where text is not null group by 1",
    "canonical_pick": "select sha256(text) as sha256, doc_id from documents where text is not null qualify row_number() over (partition by sha256(text) order by (license_file is not null)::int desc, ingested_at desc, doc_id) = 1",
    "catalog": f"select doc_id, 'doc_' || substr(sha256(text), 1, 10) as document_id, coalesce(sha256(text), 'unknown_legacy') as sha256, ext.format, ext.category, coalesce(strlen(text), 0)::int as size_bytes from documents left join {_EXT} on lower(regexp_extract(file_path, '(\\.[^.\\\\/]+)$', 1)) = ext.x",
    "clean_text": f"select doc_id, md5({_CLEAN}) as md5 from documents",
    "word_counts": f"with {_PAGES} select document_id, page_number, length(text)::int as char_count, ({_WORDS})::int as word_count from pages where text is not null",
    "page_totals": f"with {_PAGES} select document_id, count(*) as n_pages, sum(length(text))::bigint as total_chars, sum({_WORDS})::bigint as total_words from pages where text is not null group by 1",
    "html_text": r"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript\s*>', ' ', 'g'), '(?is)<svg\b[^>]*>.*?</svg\s*>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) as plain, trim(regexp_extract(text, '(?is)<title[^>]*>(.*?)</title>', 1)) as title from documents where contains(lower(text), '<html')",
    "detect_format": f"select coalesce(ext.format, 'unknown') as format, count(*) as n from documents left join {_EXT} on lower(regexp_extract(file_path, '(\\.[^.\\\\/]+)$', 1)) = ext.x group by 1",
    "infer_types": "select unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) as \"column\", unnest([case when bool_and(regexp_full_match(v, '-?[0-9]+')) then 'Integer' when bool_and(regexp_full_match(v, '-?[0-9]+(\\.[0-9]+)?')) then 'Float' else 'String' end for v in [1]]) as type",
    "json_keys": "select unnest(json_keys(props)) as key, count(*) as n from events group by 1",
    "tokens": f"with {_PAGES}, t as (select unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-zA-Z0-9_\\-.]', ' ', 'g'), ' +'), lambda w: length(w) > 1)) as term from pages) select term, count(*) as n from t group by 1",
    "token_estimate": "select doc_id, (case when coalesce(length(text), 0) = 0 then 0 else greatest(1, length(text) // 4) end)::int as tokens from documents",
    "line_counts": "select doc_id, (case when text = '' then 0 else length(text) - length(replace(text, chr(10), '')) + case when text like '%' || chr(10) then 0 else 1 end end)::int as lines from documents where text is not null",
    "sql_statements": f"select doc_id, len(list_filter(regexp_split_to_array(text, ';\\s*'), lambda s: {_STRIP('s')} <> ''))::int as n_statements from documents where file_path like '%.sql' and text is not null",
    "segments": f"with {_PAGES}, s as (select document_id, page_number, unnest(list_filter(list_transform(regexp_split_to_array(text, '[.?!;]+|\\n\\n+'), lambda x: {_STRIP('x')}), lambda x: length(x) >= 10)) as segment from pages) select document_id, page_number, count(*) as n_segments, sum(length(segment))::bigint as n_chars from s group by 1, 2",
    "classify_files": _language_sql() + "select language, file_type, count(*) as n_files, sum(case when coalesce(text, '') = '' then 0 else length(text) - length(replace(text, chr(10), '')) + case when text like '%' || chr(10) then 0 else 1 end end)::bigint as n_lines, sum(strlen(coalesce(text, '')))::bigint as n_bytes, count(*) filter (where test) as n_tests from c group by 1, 2",
    "directory_inventory": _language_sql() + "select repository_name, language, count(*) as n_files, count(*) filter (where test) as n_tests from c group by 1, 2",
    "url_parts": r"select distinct repository_url, regexp_extract(repository_url, '[/:]([^/:]+)/[^/:]+/*$', 1) as owner, regexp_extract(repository_url, '[/:]([^/:]+?)(?:\.git)?/*$', 1) as repo from documents",
    "chunk_pages": _FOLD_CHUNKS + f", one as (select document_id, page_number, unnest(cs) as c, unnest(range(len(cs))) as i from folded), s as (select *, {_STRIP('c')} as t from one) select document_id, page_number, document_id || '_p' || page_number || '_c' || (row_number() over (partition by document_id, page_number order by i) - 1) as chunk_id, length(t)::int as char_count, md5(t) as md5 from s where t <> ''",
    "chunk_index": _FOLD_CHUNKS + f", one as (select document_id, page_number, unnest(cs) as c, unnest(range(len(cs))) as i from folded), s as (select *, {_STRIP('c')} as t from one) select document_id, document_id || '_p' || page_number || '_c' || (row_number() over (partition by document_id, page_number order by i) - 1) as chunk_id, (row_number() over (partition by document_id order by page_number, i) - 1)::int as chunk_index from s where t <> ''",
    "paginate": rf"""
with l as (select doc_id::varchar as document_id, regexp_extract_all(text, '([^\n]*\n|[^\n]+$)', 1) as ls from documents where text is not null),
f as (select document_id, list_reduce(ls, lambda a, x: case when length(a.cur) + length(x) > 3000 and length(a.cur) > 0 then {{'done': list_append(a.done, a.cur), 'cur': x}} else {{'done': a.done, 'cur': a.cur || x}} end, {{'done': []::varchar[], 'cur': ''}}) as v from l),
p as (select document_id, unnest(list_append(v.done, v.cur)) as t, unnest(range(len(v.done) + 1)) as i from f),
s as (select document_id, i, {_STRIP('t')} as text from p)
select document_id, (row_number() over (partition by document_id order by i))::int as page_number, length(text)::int as char_count, ({_WORDS})::int as word_count, md5(text) as md5 from s where text <> ''
""",
}
ORACLE["infer_types"] = "\nunion all\n".join(
    f"select '{c}' as \"column\", case when bool_and(regexp_full_match({c}::varchar, '-?[0-9]+')) then 'Integer' when bool_and(regexp_full_match({c}::varchar, '-?[0-9]+(\\.[0-9]+)?')) then 'Float' when bool_and(lower({c}::varchar) in ('true', 'false', 'yes', 'no', '0', '1')) then 'Boolean' else 'String' end as type from customer"
    for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
)
