"""Tiers of tables for documents: catalog, status log, pages, chunks, context and the graph.

Tables are Parquet directories in versions: a writer makes a new version and then moves a small pointer, so readers see
either the old table or the new one whole. Appends are plain Parquet appends."""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import chunking, extraction, graph, merge
from ..operators.lineage import cut
from . import readers

_SCHEMA = {"metadata": schemas.DOCUMENT, "status": schemas.STATUS, "extracted_pages": schemas.PAGE, "chunks": schemas.CHUNK, "entities": schemas.ENTITY, "relationships": schemas.RELATIONSHIP, "vertices": schemas.VERTEX, "edges": schemas.EDGE, "raw": schemas.RAW, "graph_sync": schemas.SYNC}
_NO_COUNTS = {"vertices_created": 0, "vertices_existing": 0, "edges_created": 0, "edges_existing": 0}


class Storage(Protocol):
    """What the pipelines ask of a store of documents; Lakehouse keeps it in Parquet, others may in any table format."""

    def ingest_contents(self, contents: DataFrame) -> DataFrame: ...
    def by_hash(self, sha256: str) -> DataFrame: ...
    def path_of(self, document_id: str) -> str | None: ...
    def metadata(self, document_id: str) -> DataFrame: ...
    def documents(self) -> DataFrame: ...
    def set_status(self, ids: DataFrame, status: str, error: str | None = None, **more: str) -> None: ...
    def add(self, tier: str, df: DataFrame) -> None: ...
    def replace(self, tier: str, df: DataFrame) -> None: ...
    def put(self, tier: str, df: DataFrame, key: str = "document_id") -> None: ...
    def read(self, tier: str) -> DataFrame: ...
    def document(self, document_id: str) -> dict[str, DataFrame]: ...
    def delete(self, document_ids: list[str]) -> None: ...
    def record_sync(self, counts: dict[str, int]) -> None: ...


class Lakehouse:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # tables

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def version(self, tier: str) -> int:
        """Of a table; 0 if it was never written. Versions are the names of finished directories."""
        fs, base = self._fs(), self._path(tier)
        if not fs.exists(base):
            return 0
        done = [int(s.getPath().getName()[1:]) for s in fs.listStatus(base) if s.getPath().getName().startswith("v") and fs.exists(self._path(tier, s.getPath().getName(), "_SUCCESS"))]
        return max(done, default=0)

    def read(self, tier: str) -> DataFrame:
        """The newest version; an empty table if there is none."""
        v = self.version(tier)
        return self.spark.read.parquet(f"{self.root}/{tier}/v{v}") if v else self.spark.createDataFrame([], _SCHEMA[tier])

    def replace(self, tier: str, df: DataFrame) -> None:
        """A new version; the one before the last is removed."""
        v = self.version(tier)
        df.write.mode("overwrite").parquet(f"{self.root}/{tier}/v{v + 1}")
        if v > 1:
            self._fs().delete(self._path(tier, f"v{v - 1}"), True)

    def add(self, tier: str, df: DataFrame) -> None:
        v = self.version(tier) or 1
        df.write.mode("append").parquet(f"{self.root}/{tier}/v{v}")

    def put(self, tier: str, df: DataFrame, key: str = "document_id") -> None:
        """Rows of some documents replace all rows that those had."""
        old = self.read(tier)
        ids = df.select(F.col(key).alias("__id")).distinct()
        self.replace(tier, old.join(ids, F.col(key) == F.col("__id"), "left_anti").unionByName(df, allowMissingColumns=True).select(*old.columns))

    def drop_rows(self, tier: str, ids: DataFrame, key: str = "document_id") -> None:
        if self.version(tier):
            self.replace(tier, self.read(tier).join(ids.select(F.col("document_id").alias("__id")).distinct(), F.col(key) == F.col("__id"), "left_anti"))

    def save_json(self, tier: str, path: str) -> None:
        """A tier as JSON lines, one file per partition, nested values as they are."""
        self.read(tier).write.mode("overwrite").json(path)

    def create(self) -> None:
        """Empty vertex and edge tables where there are none, so that readers need not ask."""
        for tier in ("vertices", "edges"):
            if not self.version(tier):
                self.replace(tier, self.read(tier))

    # documents

    def ingest(self, path: str) -> DataFrame:
        """Catalog files; content that is known already keeps its row. Returns the new rows."""
        return self._catalogued(readers.files(self.spark, path))

    def ingest_contents(self, contents: DataFrame) -> DataFrame:
        """Catalog contents (document_name, content) that are no files and keep them in the raw tier. Returns the new rows."""
        found = contents.select("document_name", F.col("content").cast("binary").alias("content")).where("content is not null")
        found = found.withColumns({"path": F.lit(None).cast("string"), "size_bytes": F.octet_length("content").cast("long")})
        new = self._catalogued(found)
        kept = found.groupBy(F.sha2("content", 256).alias("sha256")).agg(F.min("content").alias("content")).join(new.select("sha256", "document_id", "document_name"), "sha256")
        self.add("raw", kept.select("document_id", "document_name", "content"))
        return new

    def _catalogued(self, found: DataFrame) -> DataFrame:
        cat = readers.catalog(found).where("error is null").drop("content")
        rows = cat.groupBy("sha256").agg(*[F.min_by(c, F.struct("document_name", "path")).alias(c) for c in ("document_id", "document_name", "format", "mime", "category", "size_bytes", "path")])
        new = rows.join(self.read("metadata").select("sha256"), "sha256", "left_anti")
        row = new.select("document_id", "document_name", "sha256", "format", "mime", "category", F.col("size_bytes").cast("long").alias("size_bytes"), F.lit("UPLOADED").alias("status"), F.current_timestamp().alias("uploaded_at"), "path", F.lit(None).cast("string").alias("error"), F.create_map().cast("map<string,string>").alias("custom_metadata"))
        row = cut(row, "ingested")  # the new rows, whatever the catalog holds later
        self.add("metadata", row)
        return row

    def by_hash(self, sha256: str) -> DataFrame:
        return self.documents().where(F.col("sha256") == sha256).limit(1)

    def metadata(self, document_id: str) -> DataFrame:
        return self.documents().where(F.col("document_id") == document_id)

    def path_of(self, document_id: str) -> str | None:
        """Where a document's file is; null for contents that are no file."""
        r = self.read("metadata").where(F.col("document_id") == document_id).select("path").first()
        return r and r.path

    def documents(self) -> DataFrame:
        """The catalog with each document's latest status, newest first; rows without a hash are told as such."""
        last = self.read("status").groupBy("document_id").agg(F.max_by("status", "updated_at").alias("__s"), F.max_by("error", "updated_at").alias("__e"))
        joined = self.read("metadata").join(last, "document_id", "left")
        return joined.withColumns({"status": F.coalesce("__s", "status"), "error": F.coalesce("__e", "error"), "sha256": F.coalesce("sha256", F.lit("unknown_legacy"))}).drop("__s", "__e").orderBy(F.desc("uploaded_at"), "document_id")

    def set_status(self, ids: DataFrame, status: str, error: str | None = None, **more: str) -> None:
        """A row in the status log for each id; further values go to custom_metadata."""
        if status not in schemas.STATUSES:
            raise ValueError(status)
        pairs = [x for k, v in more.items() for x in (F.lit(k), F.lit(str(v)))]
        extra = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        self.add("status", ids.select("document_id", F.lit(status).alias("status"), F.current_timestamp().alias("updated_at"), F.lit(error).cast("string").alias("error"), extra.alias("custom_metadata")))

    def delete(self, document_ids: list[str]) -> None:
        """Documents go from all tiers; the graph is made anew of what the others say."""
        self.delete_rows(self.spark.createDataFrame([(i,) for i in document_ids], "document_id string"))

    def delete_rows(self, gone: DataFrame) -> None:
        """As delete(), for ids (document_id) in a table."""
        for tier in ("metadata", "status", "extracted_pages", "chunks", "raw"):
            self.drop_rows(tier, gone)
        for tier in ("entities", "relationships"):
            self.drop_rows(tier, gone, "source.document_id")
        if self.version("vertices") or self.version("edges"):
            vs, es = self.graph()
            self.replace("vertices", vs)
            self.replace("edges", merge.prune_ends(es, self.read("vertices")))

    def _contents(self, ids: DataFrame) -> DataFrame:
        """(path, document_name, content, size_bytes) of catalogued documents: files, and what the raw tier keeps."""
        kept = self.read("raw").join(ids.select("document_id"), "document_id", "left_semi").select(F.lit(None).cast("string").alias("path"), "document_name", "content", F.octet_length("content").cast("long").alias("size_bytes"))
        paths = [r.path for r in ids.where("path is not null").select("path").distinct().toLocalIterator()]  # the batch's file names, which the reader takes as a list
        if not paths:
            return kept
        return kept.unionByName(self.spark.read.format("binaryFile").load(paths).select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("document_name"), "content", F.col("length").alias("size_bytes")))

    def extract(self, reprocess: bool = False) -> tuple[DataFrame, DataFrame]:
        """Pages and chunks of all documents that aren't done; (ids, broken ids with their errors) of this run.

        Rows of a document replace those that it had, so a second run changes nothing."""
        todo = self.documents() if reprocess else self.documents().where("status not in ('COMPLETED', 'FAILED')")
        ids = cut(todo.select("document_id", "path", "document_name"), "todo")
        if ids.isEmpty():
            return ids, ids.select("document_id", F.lit("").alias("error"))
        self.set_status(ids, "EXTRACTING")
        cat = readers.catalog(self._contents(ids)).dropDuplicates(["document_id"])
        pages, meta = readers.extract(cat)
        self.drop_rows("extracted_pages", ids)
        self.add("extracted_pages", pages)
        broken = cut(meta.where("error is not null").select("document_id", "error"), "broken")
        done_pages = self.read("extracted_pages").join(ids.select("document_id"), "document_id", "left_semi")
        self.drop_rows("chunks", ids)
        self.add("chunks", chunking.chunks(done_pages))
        self.set_status(ids, "EXTRACTED")
        return ids, broken

    def process(self, reprocess: bool = False, names=None) -> dict[str, int]:
        """Extract, chunk, name and link all documents that aren't completed; one plan and one write per tier.

        Returns counts of created and existing vertices and edges and records them in graph_sync. A document that fails to
        parse becomes FAILED. What a document said before is replaced, so a second run leaves the same tables."""
        ids, broken = self.extract(reprocess)
        if ids.isEmpty():
            return dict(_NO_COUNTS)
        self.set_status(ids, "GENERATING_CONTEXT")
        chunks = self.read("chunks").join(ids.select("document_id"), "document_id", "left_semi")
        source = F.struct("document_id", F.lit(None).cast("string").alias("document_name"), "page_number", "chunk_id", F.lit(None).cast("string").alias("source_text"))
        es = extraction.entities(chunks, names).select("name", F.col("cname").alias("canonical_name"), "type", F.lit(None).cast("string").alias("description"), F.array(F.col("name")).alias("aliases"), source.alias("source"), "confidence")
        rs = extraction.relationships(chunks, names).select("source_entity", "target_entity", "relationship_type", "description", source.alias("source"), "weight")
        for tier, rows in (("entities", es), ("relationships", rs)):
            self.drop_rows(tier, ids, "source.document_id")
            self.add(tier, rows)
        self.set_status(ids, "BUILDING_GRAPH")
        counts = self.build_graph()
        self.set_status(ids.join(broken, "document_id", "left_anti"), "COMPLETED", **{k: str(v) for k, v in counts.items()})
        self.set_status(broken, "FAILED", "the file could not be parsed")
        self.record_sync(counts)
        return counts

    def record_sync(self, counts: dict[str, int]) -> None:
        """A row of the graph's last change."""
        self.add("graph_sync", self.spark.range(1).select(F.current_timestamp().alias("synced_at"), *[F.lit(counts[k]).cast("long").alias(k) for k in _NO_COUNTS]))

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Vertices and edges that all entities and relationships amount to."""
        es = self.read("entities").withColumn("ord", F.struct(F.col("source.document_id"), F.col("source.chunk_id"), "name"))
        m = merge.merge_entities(es, "canonical_name", ["ord"])
        null = lambda t: F.lit(None).cast(t)
        vs = m.select(F.col("canonical_name").alias("id"), F.col("type").alias("label"), "name", "description", F.array_join("aliases", ", ").alias("aliases"), *[null("string").alias(c) for c in ("repository_name", "repository_url", "branch", "commit_sha", "file_path")], null("int").alias("start_line"), null("int").alias("end_line"), null("string").alias("source_snippet"), F.lit("HEURISTIC").alias("extraction_method"), "confidence", F.create_map().cast("map<string,string>").alias("properties"))
        rs = self.read("relationships").withColumn("ord", F.struct(F.col("source.document_id"), F.col("source.chunk_id")))
        em = merge.merge_relationships(rs, "source_entity", "target_entity", "relationship_type", ["ord"])
        return vs, em.select("src", "label", "dst", "weight", "description", *[null("string").alias(c) for c in ("repository_name", "commit_sha", "file_path")], null("int").alias("start_line"), null("int").alias("end_line"), F.lit("HEURISTIC").alias("extraction_method"))

    def build_graph(self) -> dict[str, int]:
        """Merge all entities and relationships and upsert them as vertices and edges."""
        vs, edges = self.graph()
        old_v, old_e = self.read("vertices"), self.read("edges")
        counts = graph.ingest_counts(old_v, old_e, vs, merge.prune_ends(edges, vs)).first().asDict()
        self.replace("vertices", graph.upsert_vertices(old_v, vs))
        self.replace("edges", graph.upsert_edges(old_e, edges, self.read("vertices")))
        return counts

    def document(self, document_id: str) -> dict[str, DataFrame]:
        """A document's rows by tier, its entities and relationships, and its part of the graph."""
        own = F.col("document_id") == document_id
        said = F.col("source.document_id") == document_id
        out = {"metadata": self.documents().where(own)} | {t: self.read(t).where(own) for t in ("extracted_pages", "chunks")} | {t: self.read(t).where(said) for t in ("entities", "relationships")}
        es = self.read("edges").join(out["relationships"].select(F.col("source_entity").alias("src"), F.col("relationship_type").alias("label"), F.col("target_entity").alias("dst")).distinct(), ["src", "label", "dst"], "left_semi")
        named = out["entities"].select(F.col("canonical_name").alias("id")).union(es.select("src")).union(es.select("dst")).distinct()
        return out | {"edges": es, "vertices": self.read("vertices").join(named, "id", "left_semi")}

    def flat_context(self) -> DataFrame:
        """Entities with their source's fields as columns of their own."""
        return self.read("entities").select("*", "source.*").drop("source")

    def summary(self) -> str:
        """What the tiers hold, as JSON."""
        return json.dumps({t: self.read(t).count() for t in ("metadata", "extracted_pages", "chunks", "vertices", "edges")})
