"""Queries of the problems on text corpora, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import credentials, handwritten, leakage, names, residue, split, tokenize, validity


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pieces(s: SparkSession, d: str) -> DataFrame:
    pages = _table(s, d, "extracted_pages").select("document_id", "page_number", "text").distinct()
    return split.split_pages(pages, ["document_id", "page_number"])


def _credentials(s: SparkSession, d: str) -> DataFrame:
    docs = credentials.found_in_text(_table(s, d, "documents"), "documents", "doc_id", "text")
    snippets = credentials.found_in_text(_table(s, d, "git_entities"), "git_entities", "record_id", "provenance.source_snippet")
    variables = credentials.found_in_variables(_table(s, d, "docker_services"), "docker_services", "service_id", "environment_vars")
    return docs.unionByName(snippets).unionByName(variables)


def _redacted(s: SparkSession, d: str) -> DataFrame:
    docs = credentials.redacted(_table(s, d, "documents"), "documents", "doc_id", "text")
    snippets = credentials.redacted(_table(s, d, "git_entities"), "git_entities", "record_id", "provenance.source_snippet")
    variables = credentials.redacted_variables(_table(s, d, "docker_services"), "docker_services", "service_id", "environment_vars")
    return docs.unionByName(snippets).unionByName(variables)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": lambda s, d: validity.checked(_table(s, d, "documents")).where("broken").select("doc_id"),
    "p1_rates": lambda s, d: validity.rates(_table(s, d, "documents")),
    "p2_found": lambda s, d: handwritten.classified(_table(s, d, "documents")).select("doc_id"),
    "p2_kinds": lambda s, d: handwritten.classified(_table(s, d, "documents")).withColumn("evidence", F.array_join("evidence", ",")),
    "p2_evidence": lambda s, d: handwritten.evidence(_table(s, d, "documents")).groupBy("kind", "evidence").agg(F.count_distinct("doc_id").alias("n")),
    "p2_handwritten": lambda s, d: handwritten.handwritten(_table(s, d, "documents")).select("doc_id", "repository_name", "file_path"),
    "p4_found": _credentials,
    "p4_redacted": _redacted,
    "p5_found": lambda s, d: names.linked_pairs(_table(s, d, "doc_entities")),
    "p5_groups": lambda s, d: names.groups(_table(s, d, "doc_entities")),
    "p6_found": lambda s, d: split.oversized(_table(s, d, "extracted_pages"), ["document_id", "page_number"]),
    "p6_pieces": _pieces,
    "p7_ids": lambda s, d: tokenize.token_ids(_table(s, d, "documents"), tokenize.vocabulary_path(s)),
    "p7_round_trip": lambda s, d: tokenize.round_trip(_table(s, d, "documents"), tokenize.vocabulary_path(s)),
    "p8_found": lambda s, d: leakage.leaks(_table(s, d, "documents"), _table(s, d, "benchmark")),
    "p8_documents": lambda s, d: leakage.leaked_documents(_table(s, d, "documents"), _table(s, d, "benchmark")),
    "p8_items": lambda s, d: leakage.leaked_items(_table(s, d, "documents"), _table(s, d, "benchmark")),
    "p9_found": lambda s, d: residue.residue(_table(s, d, "documents")).select("doc_id"),
    "p9_kept": lambda s, d: residue.without_residue(_table(s, d, "documents")).select("doc_id", "repository_name", "file_path"),
    "p9_effects": lambda s, d: residue.effects(_table(s, d, "documents")),
    "p9_validation": lambda s, d: residue.validation(_table(s, d, "documents")),
}

_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_LEAKS = f"""
with w as (select doc_id, {_WORDS} as ws from documents where text is not null),
d as (select doc_id, array_to_string(ws[i : i + 19], ' ') as gram from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from w where len(ws) >= 20)),
b as (select item_id, {_WORDS} as ws from benchmark where text is not null),
g as (select distinct item_id, array_to_string(ws[i : i + 19], ' ') as gram from (select item_id, ws, unnest(range(1, len(ws) - 18)) as i from b where len(ws) >= 20)),
pairs as (select distinct doc_id, item_id from d join g using (gram))
"""
ORACLE: dict[str, str] = {
    "p6_found": "select distinct document_id, page_number from extracted_pages where length(text) > 800",
    "p8_found": _LEAKS + "select doc_id, item_id from pairs",
    "p8_documents": _LEAKS + "select doc_id, count(*) as n_items, list_sort(list(item_id)) as items from pairs group by 1",
    "p8_items": _LEAKS + "select i.item_id, count(p.doc_id) as n_docs from (select distinct item_id from benchmark) i left join pairs p using (item_id) group by 1",
    "p7_round_trip": None,
}
ORACLE = {k: v for k, v in ORACLE.items() if v}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE
