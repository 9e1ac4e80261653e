"""Queries of extraction: entities, relationships, structure, code symbols, configuration and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gazetteer, refdata
from ..operators import chunking, code, extraction, merge
from ..sources import formats
from .text_queries import _FOLD_CHUNKS, _STRIP, _docs, _pages


def _chunks(s: SparkSession, d: str) -> DataFrame:
    """Pages and documents as chunks."""
    docs = _docs(s, d).where("text is not null").select(F.concat(F.lit("file_"), "doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.concat(F.lit("file_"), "doc_id").alias("chunk_id"), F.lit(0).alias("chunk_index"), "text")
    pages = chunking.chunks(_pages(s, d)).select("document_id", "page_number", "chunk_id", "chunk_index", "text")
    return docs.unionByName(pages)


def _schemas(s: SparkSession, d: str) -> DataFrame:
    """Schemas of the tables as rows: a few dozen, made on the driver from the files' footers."""
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
    rows = [("star", n, f.name, f.dataType.simpleString()) for n in names for f in s.read.parquet(f"{d}/{n}.parquet").schema]
    return s.createDataFrame(rows, "document_name string, table_name string, column_name string, data_type string")


def _named(s: SparkSession, d: str, pattern: str) -> DataFrame:
    return _docs(s, d).where(F.col("file_path").rlike(pattern))


def entities(s: SparkSession, d: str) -> DataFrame:
    """Entities of every kind in the chunks of all pages and documents, once per chunk and canonical name."""
    return extraction.entities(_chunks(s, d)).select("chunk_id", F.col("cname").alias("canonical_name"), "type")


def all_entities(s: SparkSession, d: str) -> DataFrame:
    """As entities(), with spellings, confidences and snippets."""
    return extraction.entities(_chunks(s, d)).withColumnRenamed("cname", "canonical_name")


def relationships(s: SparkSession, d: str) -> DataFrame:
    return extraction.relationships(_chunks(s, d)).groupBy("source_entity", "relationship_type", "target_entity").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))


def entity_counts(s: SparkSession, d: str) -> DataFrame:
    return extraction.entities(_chunks(s, d)).groupBy("type", "cname").agg(F.count("*").alias("n"))


def structure(s: SparkSession, d: str) -> DataFrame:
    es, rs = extraction.structural(_schemas(s, d))
    return es.select(F.col("canonical_name").alias("a"), F.col("type").alias("kind"), F.col("name").alias("b")).unionByName(rs.select(F.col("source_entity").alias("a"), F.col("relationship_type").alias("kind"), F.col("target_entity").alias("b")))


def symbol_counts(s: SparkSession, d: str) -> DataFrame:
    return code.symbols(_docs(s, d), formats.classify("file_path")[0]).groupBy("kind", "name").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def code_graph(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d)
    es, rs = code.code_graph(docs, code.symbols(docs, formats.classify("file_path")[0]), calls=True)
    return es.groupBy(F.col("entity_type").alias("kind")).agg(F.count("*").alias("n")).unionByName(rs.groupBy(F.col("relationship_type").alias("kind")).agg(F.count("*").alias("n")))


def created_ends(s: SparkSession, d: str) -> DataFrame:
    rel = extraction.relationships(_chunks(s, d)).select(F.col("source_entity").alias("src"), F.col("target_entity").alias("dst"))
    es = merge.merge_entities(s.read.parquet(f"{d}/doc_entities.parquet"), "canonical_name", ["mention_id"])
    return merge.create_ends(rel, es).groupBy("type").agg(F.count("*").alias("n"))


QUERIES = {
    "entities": entities,
    "all_entities": all_entities,
    "entity_counts": entity_counts,
    "relationships": relationships,
    "created_ends": created_ends,
    "structural_schema": structure,
    "code_symbols": symbol_counts,
    "code_graph": code_graph,
    "requirements": lambda s, d: code.requirements(_named(s, d, r"requirements[^/]*\.txt$")),
    "package_json": lambda s, d: code.package_json(_named(s, d, r"package\.json$")),
    "dockerfile": lambda s, d: code.dockerfile(_named(s, d, r"Dockerfile$")),
    "markdown_terms": lambda s, d: code.markdown_terms(_named(s, d, r"\.md$"), refdata.MARKDOWN_TECHNOLOGIES | refdata.MARKDOWN_CONCEPTS),
}


def _entities_sql() -> str:
    """CTE ``found`` (chunk_id, canonical_name, type): known names, then people, organisations and projects."""
    quoted = lambda x: x.replace("'", "''")
    rows = ", ".join(f"('{quoted(can)}', '{kind}', '{quoted(extraction._word(s))}')" for can, kind, other in gazetteer.known() for s in [can, *other])
    stop = "[" + ", ".join(f"'{w}'" for w in sorted(gazetteer.NOT_NAMES)) + "]"
    line = f"list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: {_STRIP('x')}), lambda x: x <> '')[1]"
    return f"""{_FOLD_CHUNKS}, one as (select document_id, page_number, unnest(cs) as c, unnest(range(len(cs))) as i from folded), cut as (select *, {_STRIP('c')} as t from one),
chunk as (select document_id || '_p' || page_number || '_c' || (row_number() over (partition by document_id, page_number order by i) - 1) as chunk_id, page_number, row_number() over (partition by document_id order by page_number, i) - 1 as k, t as text from cut where t <> '' union all select 'file_' || doc_id, 1, 0, text from documents where text is not null),
known as (select distinct chunk_id, k.c as e, k.t as type from chunk join (values {rows}) as k(c, t, p) on regexp_matches(text, '(?i)' || k.p)),
person as (select chunk_id, {_TITLE('line')} as e from (select chunk_id, {line} as line from chunk where page_number = 1 and k = 0) where regexp_matches(line, '^[A-Z][a-zA-Z]+(?:\\s+[A-Z][a-zA-Z]+){{1,2}}$')),
org as (select chunk_id, regexp_replace(x, '(?i)^(?:in|for|of|and|with|by|at|from)\\s+', '') as e from (select chunk_id, unnest(regexp_extract_all(text, '\\b([A-Z][a-zA-Z'']+(?:\\s+(?:{extraction._ORG_TAIL}))+)\\b', 1)) as x from chunk)),
project as (select chunk_id, unnest(regexp_extract_all(text, '(?i)(?:Project|Project Name)\\s*[:\\-]\\s*([A-Z][a-zA-Z0-9]+(?:\\s+[A-Z][a-zA-Z0-9]+){{1,4}})', 1)) as e from chunk),
every as (select chunk_id, e, type, 0 as o from known union all select chunk_id, e, 'Person', 1 from person where not list_contains({stop}, upper(e)) union all select chunk_id, e, 'Organization', 2 from org where length(e) > 12 and not list_contains({stop}, upper(e)) and not list_contains({stop}, upper(regexp_extract(e, '^(\\S+)', 1))) and not regexp_matches(upper(regexp_extract(e, '^(\\S+)', 1)), '{extraction._NO_ORG}')
  union all select chunk_id, e, 'Project', 3 from project where length(e) > 5 and not list_contains({stop}, upper(e))),
found as (select chunk_id, e as canonical_name, arg_min(type, o) as type from every group by 1, 2)"""


_TITLE = lambda x: f"array_to_string(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|[^\\p{{L}}]+)'), lambda p: upper(p[1]) || lower(p[2:])), '')"
_LINES = "select doc_id, unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) as raw, unnest(range(1, len(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) + 1))::int as line_number from documents where text is not null and "
_TERM = refdata.MARKDOWN_TECHNOLOGIES | refdata.MARKDOWN_CONCEPTS
ORACLE = {
    "entities": _entities_sql() + " select chunk_id, canonical_name, type from found",
    "entity_counts": _entities_sql() + " select type, canonical_name as cname, count(*) as n from found group by 1, 2",
    "requirements": f"with l as ({_LINES} regexp_matches(file_path, 'requirements[^/]*\\.txt$')), t as (select *, trim(raw, ' ' || chr(9)) as line from l), k as (select *, regexp_extract(line, '^([a-zA-Z0-9_\\-.]+)(.*)$', 1) as name from t where line <> '' and not regexp_matches(line, '^(#|-r|-e)')) select doc_id, line_number, name, regexp_replace(replace(lower(name), '_', '-'), '-binary$', '') as canonical_name, nullif(trim(regexp_extract(line, '^([a-zA-Z0-9_\\-.]+)(.*)$', 2)), '') as version_spec from k where name <> ''",
    "dockerfile": f"with l as ({_LINES} file_path like '%Dockerfile'), p as (select doc_id, line_number, upper(regexp_extract(raw, '^\\s*((?i:FROM|RUN|CMD|COPY|ADD|ENV|ARG|EXPOSE|WORKDIR|ENTRYPOINT|USER|VOLUME|LABEL|HEALTHCHECK))\\s+(.*?)\\s*$', 1)) as instruction, regexp_extract(raw, '^\\s*((?i:FROM|RUN|CMD|COPY|ADD|ENV|ARG|EXPOSE|WORKDIR|ENTRYPOINT|USER|VOLUME|LABEL|HEALTHCHECK))\\s+(.*?)\\s*$', 2) as value from l) select * from p where instruction <> ''",
    "package_json": "with j as (select doc_id, case when json_valid(text) then text::json end as j from documents where file_path like '%package.json' and text is not null), d as (select doc_id, unnest(json_keys(j, '$.dependencies')) as name, j, false as is_dev from j union all select doc_id, unnest(json_keys(j, '$.devDependencies')), j, true from j) select doc_id, name, json_extract_string(j, case when is_dev then '$.devDependencies.\"' else '$.dependencies.\"' end || name || '\"') as version_spec, is_dev from d",
    "markdown_terms": "with m as (select doc_id, lower(text) as t from documents where file_path like '%.md' and text is not null), k(p, c) as (values " + ", ".join(f"('\\b{__import__('re').escape(t)}\\b', '{c}')" for t, c in _TERM.items()) + "), h as (select doc_id, c, len(regexp_extract_all(t, p)) as n, length(regexp_split_to_array(t, p)[1]) - length(replace(regexp_split_to_array(t, p)[1], chr(10), '')) + 1 as line from m join k on regexp_matches(t, p)) select doc_id, c as term, sum(n)::bigint as mentions, min(line)::int as first_line from h group by 1, 2",
    "structural_schema": "with c as (select 'star::' || table_name as t, table_name, column_name, case data_type when 'INTEGER' then 'int' when 'BIGINT' then 'bigint' when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' when 'TIMESTAMP' then 'timestamp_ntz' end as k from information_schema.columns where table_name in ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem')) select distinct t as a, 'Table' as kind, table_name as b from c union all select t || '.' || column_name, 'Column', table_name || '.' || column_name from c union all select distinct k, 'DataType', k from c union all select t, 'CONTAINS_COLUMN', t || '.' || column_name from c union all select t || '.' || column_name, 'HAS_DATA_TYPE', k from c",
}
