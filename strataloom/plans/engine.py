"""The facade: questions over a code graph, a document graph and passages to a ranked, cited context."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import retrieval

ITEM = "qid int, item_id string, type string, title string, content string, graph_score double, semantic_score double, provenance_score double, start_line int, page_number int, origin string"
MODES = ("hybrid", "graph", "semantic")


@dataclass
class Answer:
    question: str
    analysis: dict
    items: list[dict]
    context: str
    citations: list[dict]
    tokens: int
    stats: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Scope:
    """What a question is about: a repository, a document by id or name, both, or everything."""

    repository: str | None = None
    document_id: str | None = None
    document_name: str | None = None

    @property
    def documents(self) -> bool:
        return bool(self.document_id or self.document_name)

    def code(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("repository_name") == self.repository) if self.repository else df

    def document(self, df: DataFrame, fold: bool = False) -> DataFrame:
        """Rows of the document, by either of id and name; fold: names in any case."""
        if not self.documents:
            return df
        name, said = F.col("document_name"), self.document_name or ""
        named = F.lower(name) == said.lower() if fold else name == said
        by_id = F.col("document_id") == (self.document_id or "")
        return df.where(F.coalesce(by_id, F.lit(False)) | F.coalesce(named, F.lit(False)) if self.document_id and self.document_name else by_id if self.document_id else named)

    def passages(self, df: DataFrame) -> DataFrame:
        """Passages of the repository, those of the document, or all; statistics are then those of what remains."""
        of_code, of_text = df.where("repository_name is not null"), df.where("repository_name is null")
        if not self.repository and not self.documents:
            return df
        parts = [self.code(of_code)] if self.repository else []
        parts += [self.document(of_text, fold=True)] if self.documents else []
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def code_passages(vs: DataFrame) -> DataFrame:
    """Vertices that have a snippet or a description, as passages of their repository."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")).isin("", '""') == F.lit(False)
    return vs.where(some("source_snippet") | some("description")).select(
        F.concat(F.lit("code:"), "id").alias("pid"), F.trim(F.concat_ws(" ", "name", "file_path", "description", "source_snippet")).alias("text"), "repository_name", F.lit(None).cast("string").alias("document_id"), F.lit(None).cast("string").alias("document_name"),
        "start_line", F.lit(None).cast("int").alias("page_number"), F.coalesce("commit_sha", F.lit("")).alias("origin"),
    )


def document_passages(chunks: DataFrame) -> DataFrame:
    """Chunks of pages (document_id, document_name, page_number, chunk_id, text) as passages of their document."""
    return chunks.where(F.length("text") > 0).select(
        F.concat(F.lit("chunk:"), "chunk_id").alias("pid"), "text", F.lit(None).cast("string").alias("repository_name"), "document_id", "document_name", F.lit(None).cast("int").alias("start_line"), "page_number", F.col("document_id").alias("origin")
    )


def passage_items(passages: DataFrame, asked: DataFrame, limit: int, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The best passages for each question (see retrieval.terms_of) as candidates, with the columns of ITEM."""
    hits = retrieval.bm25(passages, asked, limit, index=index)
    return hits.join(passages, "pid").select(
        "qid", F.col("pid").alias("item_id"), F.when(F.col("repository_name").isNull(), "chunk").otherwise("file").alias("type"), F.coalesce("document_name", "pid").alias("title"), F.col("text").alias("content"), F.lit(0.0).alias("graph_score"), F.col("score").alias("semantic_score"),
        F.lit(1.0).alias("provenance_score"), "start_line", "page_number", "origin",
    )


def ranked(candidates: DataFrame, asked: DataFrame, top_k: int, weights: tuple[float, float, float]) -> DataFrame:
    """The best candidates of each question, numbered; of equal ids the best one, of equal contents the first."""
    told = candidates.join(asked.select("qid", "intent", "entities", "targets"), "qid")
    scored = retrieval.rank(told, F.col("intent"), F.col("entities"), F.col("targets"), weights)
    once = scored.withColumn("said", F.md5(F.lower(text.strip("content"))))
    by_id = once.groupBy("qid", "item_id").agg(F.max_by(F.struct(*once.columns), F.struct("score", "said")).alias("x")).select("x.*")
    by_content = by_id.groupBy("qid", "said").agg(F.min_by(F.struct(*by_id.columns), F.struct((-F.col("score")).alias("s"), "item_id")).alias("x")).select("x.*")
    return retrieval.top_k(by_content, top_k, ["qid"]).drop("intent", "entities", "targets", "said")


class ContextEngine:
    """Hybrid, graph-only or semantic retrieval over a code graph, passages (see code_passages and document_passages) and,
    if there is one, a graph of documents (vertices with document_id, document_name, page_number and source_text).

    A stage that fails is told in the statistics' errors and doesn't end the query."""

    def __init__(self, vertices: DataFrame, edges: DataFrame, passages: DataFrame, document_vertices: DataFrame | None = None, document_edges: DataFrame | None = None) -> None:
        self.vertices, self.edges = vertices, edges
        self.documents = (document_vertices, document_edges) if document_vertices is not None else None
        kinds = {"repository_name": "string", "document_id": "string", "document_name": "string", "start_line": "int", "page_number": "int", "origin": "string"}
        self.passages = passages.select("pid", "text", *[F.col(c) if c in passages.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])

    @cached_property
    def index(self) -> dict:
        """Words of the graphs and postings of the passages, written at the first question that comes alone."""
        out = {"code": retrieval.word_index(self.vertices, ["repository_name"]), "passages": retrieval.bm25_index(self.passages, ["repository_name", "document_id", "document_name"])}
        if self.documents:
            out["documents"] = retrieval.word_index(self.documents[0], ["document_id", "document_name"], retrieval.DOCUMENT_SEARCHED)
        return out

    def candidates(self, asked: DataFrame, mode: str = "hybrid", top_k: int = 8, hops: int = 1, scope: Scope = Scope(), indexed: bool = False) -> dict[str, Callable[[], DataFrame]]:
        """Makers of the candidates of all questions (see retrieval.terms_of) by stage: code, documents, passages.

        indexed: for few questions, which name the words that are read."""
        index = self.index if indexed else None
        if mode not in MODES:
            raise ValueError(mode)
        out = {}
        if mode != "semantic":
            tokens = retrieval.asked_graph(asked)
            if scope.repository or not scope.documents:
                out["code"] = lambda: retrieval.graph_candidates(scope.code(self.vertices), scope.code(self.edges), tokens, 2 * top_k, 4 * top_k, hops, words=index and scope.code(index["code"]))
            if self.documents and (scope.documents or not scope.repository):
                vs, es = self.documents
                out["documents"] = lambda: retrieval.graph_candidates(scope.document(vs), scope.document(es), tokens, 2 * top_k, 4 * top_k, hops, "document", index and scope.document(index["documents"]))
        if mode != "graph":
            out["passages"] = lambda: passage_items(scope.passages(self.passages), asked, 2 * top_k, index and tuple(map(scope.passages, index["passages"])))
        return out

    def answer_all(self, questions: DataFrame, mode: str = "hybrid", top_k: int = 8, hops: int = 1, scope: Scope = Scope(), weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
        """(qid, rank, item_id, type, title, content, score, ...): the ranked items of each question (qid, query), as one plan."""
        asked = retrieval.terms_of(questions)
        parts = [make() for make in self.candidates(asked, mode, top_k, hops, scope).values()]
        pool = parts[0]
        for p in parts[1:]:
            pool = pool.unionByName(p)
        return ranked(pool, asked, top_k, weights)

    def query(
        self, question: str, mode: str = "hybrid", top_k: int = 8, budget: int = 4000, hops: int = 1, repository: str | None = None, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), document_id: str | None = None, document_name: str | None = None
    ) -> Answer:
        """One question's context. Stages are run one by one, each bounded by top_k, so that each may fail by itself."""
        spark, began = self.vertices.sparkSession, time.time()
        asked = retrieval.terms_of(spark.createDataFrame([(0, question)], "qid int, query string")).withColumn("keywords", text.keywords("query"))
        row = asked.first()
        asked = spark.createDataFrame([row], asked.schema)
        analysis = {k: row[k] for k in ("intent", "entities", "targets", "keywords", "terms")}
        stats: dict = {"errors": [], "candidates": {}}
        pool: list = []
        names = [c.split(" ")[0] for c in ITEM.split(", ")]
        stages = self.candidates(asked, mode, top_k, hops, Scope(repository, document_id, document_name), indexed=True)
        with ThreadPoolExecutor(len(stages)) as threads:  # stages wait for their own jobs, so they run side by side
            running = {stage: threads.submit(lambda make=make: make().select(*names).collect()) for stage, make in stages.items()}  # a few times top_k rows each
        for stage, run in running.items():
            try:
                got = run.result()
                pool += got
                stats["candidates"][stage] = len(got)
            except Exception as e:
                stats["errors"].append(f"{stage}: {type(e).__name__}: {str(e)[:200]}")
        items = []
        if pool:
            try:
                items = [r.asDict() for r in ranked(spark.createDataFrame(pool, ITEM), asked, top_k, weights).orderBy("rank").collect()]
            except Exception as e:
                stats["errors"].append(f"rank: {type(e).__name__}: {str(e)[:200]}")
        context, citations, tokens = retrieval.assemble(question, items, budget)
        kinds = [r.type for r in pool]
        stats |= {"returned": len(items), "nodes": kinds.count("entity"), "edges": kinds.count("relationship"), "chunks": kinds.count("chunk") + kinds.count("file"), "total_candidates": len(pool), "ms": round((time.time() - began) * 1000, 1)}
        return Answer(question, analysis, items, context, citations, tokens, stats)

    def status(self) -> dict[str, int]:
        """What there is to ask: vertices, edges, passages, and documents' vertices."""
        parts = {"vertices": self.vertices, "edges": self.edges, "passages": self.passages} | ({"document_vertices": self.documents[0]} if self.documents else {})
        return {k: df.count() for k, df in parts.items()}


def ask(vs: DataFrame, es: DataFrame, repository: str, kind: str, term: str = "") -> DataFrame:
    """One of the prepared questions about a repository: tech_stack, important_files, classes_methods, apis,
    entity_search, file_details, code_flows, or overview."""
    from ..operators import graph, insights

    v, e = graph.repository_graph(vs, es, repository)
    if kind == "tech_stack":
        return insights.usage(v, e).orderBy(F.desc("usage"), "name")
    if kind == "important_files":
        return insights.important_files(v, e).orderBy(F.desc("importance"), "file_path").limit(10)
    if kind == "classes_methods":
        return insights.class_methods(v, e).orderBy("file_path", "class_name")
    if kind == "apis":
        return insights.apis(v).orderBy("endpoint", "http_method")
    if kind == "entity_search":
        return graph.search(v, None, term).orderBy("name", "id")
    if kind == "file_details":
        return insights.important_files(v, e).where(F.lower("file_path").contains(term.lower()))
    if kind == "code_flows":
        return insights.code_flows(v, e, 30)
    return graph.stats(v, e).orderBy("kind", "label")
