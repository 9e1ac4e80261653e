"""Queries of exports, streams and the status log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import application_folder
from ..sources import export
from ..streaming import ingest
from .graph_queries import _G, tables


def graphml(s: SparkSession, d: str) -> DataFrame:
    return export.graphml_fragments(*tables(s, d))


def stream_dedup(s: SparkSession, d: str) -> DataFrame:
    """Documents as a stream without repeated contents."""
    stream = s.readStream.schema(s.read.parquet(f"{d}/documents.parquet").schema).parquet(_folder(d, "documents"))
    once = ingest.without_repeats(stream.select("text", F.col("ingested_at").cast("timestamp").alias("ingested_at"))).select("sha256", "document_id")
    return ingest.collected(once, f"{application_folder(s)}/stream-{uuid.uuid4().hex}")


def _folder(d: str, table: str) -> str:
    """A pattern that a file stream takes for a table of one file or many."""
    import os

    p = f"{d}/{table}.parquet"
    return p if os.path.isdir(p) else f"{d}/{table}.parque[t]"


def stream_windows(s: SparkSession, d: str) -> DataFrame:
    """Events as a stream, counted by hour and type."""
    stream = s.readStream.schema(s.read.parquet(f"{d}/events.parquet").schema).parquet(_folder(d, "events"))
    out = ingest.collected(ingest.windowed_counts(stream), f"{application_folder(s)}/stream-{uuid.uuid4().hex}", "complete")
    return out.groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("n_windows"), F.round(F.sum("total"), 4).alias("total"))


QUERIES = {
    "export_vertices": lambda s, d: export.vertex_rows(tables(s, d)[0]),
    "export_edges": lambda s, d: export.edge_rows(*reversed(tables(s, d))),
    "export_json": lambda s, d: export.json_rows(*tables(s, d)).select("kind", F.get_json_object("json", "$.id").alias("id"), F.get_json_object("json", "$.provenance.file_path").alias("file_path"), F.get_json_object("json", "$.provenance.start_line").cast("int").alias("start_line")),
    "export_network_edges": lambda s, d: export.network_view(*tables(s, d))[1],
    "export_graphml": graphml,
    "export_network": lambda s, d: export.network_view(*tables(s, d))[0].select("id", "label", "group", "color"),
    "stream_dedup": stream_dedup,
    "stream_windows": stream_windows,
}
_COLOUR = "case label " + " ".join(f"when '{k}' then '{v}'" for k, v in export.COLOURS.items()) + " else '#94a3b8' end"
_VROWS = "select id, id as canonical_id, label, name, label as entity_type, coalesce(file_path, '') as file_path, coalesce(start_line, 1) as start_line, coalesce(end_line, 1) as end_line, coalesce(commit_sha, '') as commit_sha, coalesce(extraction_method, '') as extraction_method, coalesce(confidence, 1.0) as confidence, coalesce(description, '') as description, coalesce(repository_name, '') as repository_name from v"
_EROWS = "select src || '|' || label || '|' || dst as id, src as source_id, src as source_canonical_id, dst as target_id, dst as target_canonical_id, label, label as relationship_type, coalesce(file_path, '') as file_path, coalesce(start_line, 1) as start_line, coalesce(end_line, 1) as end_line, coalesce(commit_sha, '') as commit_sha, coalesce(extraction_method, '') as extraction_method, coalesce(weight, 1.0) as weight, coalesce(description, '') as description, coalesce(repository_name, '') as repository_name from e"
_ESC = lambda c: f"regexp_replace(replace(replace(replace(replace(({c})::varchar, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"
_DATA = lambda mark, names: " || ".join(f"coalesce('<data key=\"{mark}_{n}\">' || {_ESC(n)} || '</data>', '')" for n in names.split())
ORACLE = {
    "export_vertices": _G + " " + _VROWS,
    "export_edges": _G + f", r as ({_EROWS}) select r.*, a.name as src_name, b.name as dst_name from r left join v a on source_id = a.id left join v b on target_id = b.id",
    "export_json": _G + f", r as ({_EROWS}), w as ({_VROWS}) select 'vertex' as kind, id, file_path, start_line from w union all select 'edge', id, file_path, start_line from r",
    "export_network_edges": _G + " select src as \"from\", dst as \"to\", label, coalesce(description, label) as title from e",
    "export_graphml": _G + f", r as ({_EROWS}), w as ({_VROWS}) select 'node' as kind, '<node id=\"' || {_ESC('id')} || '\">' || {_DATA('d', 'canonical_id name label entity_type file_path start_line end_line commit_sha extraction_method confidence repository_name')} || '</node>' as xml from w union all select 'edge', '<edge source=\"' || {_ESC('source_id')} || '\" target=\"' || {_ESC('target_id')} || '\">' || {_DATA('e', 'label relationship_type file_path start_line end_line weight repository_name')} || '</edge>' from r",
    "export_network": _G + f" select id, name as label, label as \"group\", {_COLOUR} as color from v",
    "stream_dedup": "select distinct sha256(text) as sha256, 'doc_' || substr(sha256(text), 1, 10) as document_id from documents where text is not null",
    "stream_windows": "select event_type, count(*) as n, count(distinct date_trunc('hour', ts)) as n_windows, round(sum(value), 4) as total from events group by 1",
}
