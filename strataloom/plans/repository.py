"""Repositories to graphs: scan, parse, entities and relationships, merge, upsert, insights, as plans over tables of files.

Files are rows (doc_id, repository_name, repository_url, file_path, text, commit_sha), of one repository or of many; all
steps are the same, and nothing loops over repositories."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, refdata, text
from ..operators import code, graph, insights, merge
from ..operators.lineage import cut
from ..sources import formats, readers

STEPS = ("acquire", "scan", "parse", "extract", "normalise", "ingest", "load")
ENTITY = ["canonical_id", "name", "entity_type", "repository_name", "file_path", "start_line"]
LINK = ["source_canonical_id", "relationship_type", "target_canonical_id", "repository_name", "file_path"]


def _entity(df: DataFrame, key: Column, name: Column, kind: str, line: Column | None = None) -> DataFrame:
    return df.select(key.alias("canonical_id"), name.alias("name"), F.lit(kind).alias("entity_type"), "repository_name", "file_path", (F.lit(None).cast("int") if line is None else line.cast("int")).alias("start_line"))


def _link(df: DataFrame, a: Column, kind: str | Column, b: Column) -> DataFrame:
    return df.select(a.alias("source_canonical_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("relationship_type"), b.alias("target_canonical_id"), "repository_name", "file_path")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def structure(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repositories, directories and files, with CONTAINS from each to what lies in it."""
    repo, path = F.col("repository_name"), identity.tidy_path("file_path")
    closure = insights.directory_closure(files)
    held = files.where(F.length("file_path") > 0).select("repository_name", path.alias("child")).distinct().withColumn("is_file", F.lit(True))
    every = cut(closure.join(held, ["repository_name", "child"], "left").withColumn("file_path", F.col("child")), "structure")
    up = F.when(F.col("parent") == "", identity.repo_id(repo)).otherwise(identity.part_id(repo, "dir", F.col("parent")))
    me = F.when(F.col("is_file"), identity.part_id(repo, "file", F.col("child"))).otherwise(identity.part_id(repo, "dir", F.col("child")))
    base = F.element_at(F.split("child", "/"), -1)
    repos = files.where(repo.isNotNull()).select("repository_name", F.lit("").alias("file_path")).distinct()
    es = _union([_entity(repos, identity.repo_id(repo), repo, "Repository"), _entity(every.where("is_file is null"), me, base, "Directory"), _entity(every.where("is_file"), me, base, "File", F.lit(1))])
    return es, _link(every, up, "CONTAINS", me)


def configuration(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Libraries that requirement lists and package.json declare, services of compose files with their technologies.

    Compose files that are no YAML give no services: their blocks' names alone would make services of ports and volumes."""
    named = files.withColumn("file", identity.part_id(F.col("repository_name"), "file", F.col("file_path")))
    place = named.select("doc_id", "repository_name", "file_path", "file")
    lists = code.requirements(named.where(F.col("file_path").rlike(r"requirements[^/]*\.txt$"))).select("doc_id", F.col("canonical_name").alias("library"), F.col("line_number").alias("line"))
    packages = code.package_json(named.where(F.col("file_path").rlike(r"(^|/)package\.json$"))).select("doc_id", text.canonical_library("name").alias("library"), F.lit(None).cast("int").alias("line"))
    libs = cut(lists.unionByName(packages).where("library <> ''").join(place, "doc_id"), "libraries")
    lib = identity.shared_id("lib", F.col("library"))
    services = code.compose(named.where(F.col("file_path").rlike(r"(?i)compose[^/]*\.ya?ml$"))).where("parsed").join(place, "doc_id")
    services = cut(services, "services")
    service = identity.part_id(F.col("repository_name"), "service", F.col("service_name"))
    known = services.where("inferred_technology is not null and inferred_technology <> 'Service'")
    tech = identity.shared_id("tech", F.col("inferred_technology"))
    after = services.select("repository_name", "file_path", "service_name", F.explode("depends_on").alias("other"))
    kind = F.when(F.col("service_name").rlike("(?i)(db|age|postgres)"), "CONNECTS_TO").otherwise("USES")
    es = _union([_entity(libs, lib, F.col("library"), "Library", F.col("line")), _entity(services, service, F.col("service_name"), "Service", F.col("line_number")), _entity(known, tech, F.col("inferred_technology"), "Technology")])
    rs = _union([_link(libs, F.col("file"), "DEPENDS_ON", lib), _link(services, F.col("file"), "DEFINES", service), _link(known, service, kind, tech), _link(after, service, "DEPENDS_ON", identity.part_id(F.col("repository_name"), "service", F.col("other")))])
    return es, rs


def documentation(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Technologies and concepts that Markdown files name."""
    named = files.withColumn("file", identity.part_id(F.col("repository_name"), "file", F.col("file_path")))
    docs = named.where(F.col("file_path").rlike(r"\.md$"))
    found = []
    for terms, kind, how, mark in ((refdata.MARKDOWN_TECHNOLOGIES, "Technology", "USES", "tech"), (refdata.MARKDOWN_CONCEPTS, "Concept", "DESCRIBES", "concept")):
        rows = cut(code.markdown_terms(docs, terms).join(named.select("doc_id", "repository_name", "file_path", "file"), "doc_id"), "terms")
        key = identity.shared_id(mark, F.col("term"))
        found.append((_entity(rows, key, F.col("term"), kind, F.col("first_line")), _link(rows, F.col("file"), how, key)))
    return _union([f[0] for f in found]), _union([f[1] for f in found])


def source_code(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes, functions, methods, libraries, APIs and calls of Python, JavaScript and TypeScript."""
    found = code.placed(files, code.symbols(files, formats.classify("file_path")[0]))
    es, rs = code.graph_of(cut(found, "symbols"), calls=True)
    own = F.regexp_extract("canonical_id", r"^repo:(.*?):(?:file|api)", 1)
    path = lambda c: F.regexp_extract(c, r":file:(.*?)(?::class:|:func:|$)", 1)
    e = es.select("canonical_id", "name", "entity_type", F.nullif(own, F.lit("")).alias("repository_name"), F.nullif(path("canonical_id"), F.lit("")).alias("file_path"), F.lit(None).cast("int").alias("start_line"))
    repo = F.coalesce(F.nullif(F.regexp_extract("source", r"^repo:(.*?):(?:file|api)", 1), F.lit("")))
    r = rs.select(F.col("source").alias("source_canonical_id"), "relationship_type", F.col("target").alias("target_canonical_id"), repo.alias("repository_name"), F.nullif(path("source"), F.lit("")).alias("file_path"))
    return e, r


def extracted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of all files, raw: as merge_code_entities and merge_relationships take them.

    What each part finds is written where it is found: one plan of all parts, each made for entities and again for
    relationships, took more of the driver's memory than any rows did."""
    parts = [structure(files), source_code(files), configuration(files), documentation(files)]
    info = files.groupBy("repository_name").agg(F.max("repository_url").alias("repository_url"), F.max("commit_sha").alias("commit_sha"))
    none = F.lit(None).cast("string")
    prov = F.struct("repository_url", "repository_name", none.alias("branch"), "commit_sha", "file_path", F.col("start_line").cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), none.alias("source_snippet"), F.lit("STRUCTURAL_AST").alias("extraction_method"))
    es = _union([p[0].select(*ENTITY) for p in parts]).join(info, "repository_name", "left")
    es = es.select("canonical_id", "name", "entity_type", none.alias("description"), F.create_map().cast("map<string,string>").alias("properties"), prov.alias("provenance"), F.array().cast("array<string>").alias("aliases"), F.lit(1.0).alias("confidence"), F.lit(None).cast("timestamp").alias("extracted_at"), F.xxhash64("canonical_id", "name", "entity_type", "file_path", "start_line").alias("record_id"))
    rs = _union([p[1].select(*LINK) for p in parts]).withColumn("start_line", F.lit(None)).join(info, "repository_name", "left")
    rs = rs.select("source_canonical_id", "target_canonical_id", "relationship_type", none.alias("description"), prov.alias("provenance"), F.lit(1.0).alias("weight"), F.lit(None).cast("timestamp").alias("extracted_at"), F.xxhash64("source_canonical_id", "target_canonical_id", "relationship_type", "file_path").alias("record_id"))
    return es, rs


def local_files(spark: SparkSession, path: str, subdirectory: str | None = None) -> DataFrame:
    """The files of a local repository as rows."""
    root = path.rstrip("/")
    name = root.rsplit("/", 1)[-1].removesuffix(".git")
    found = readers.repository(spark, f"{root}/{subdirectory.strip('/')}" if subdirectory else root)
    return found.select(F.xxhash64("relative_path").alias("doc_id"), F.lit(name).alias("repository_name"), F.lit(path).alias("repository_url"), F.col("relative_path").alias("file_path"), "text", F.lit(readers.commit_of(root)).alias("commit_sha"), "language", "file_type", "line_count")


def analyze(spark: SparkSession, source: str, vertices: DataFrame, edges: DataFrame, branch: str | None = None, commit: str | None = None, subdirectory: str | None = None, progress: Callable[[int, str], None] | None = None) -> tuple[dict, DataFrame, DataFrame]:
    """(summary, vertices, edges) after a repository (a directory or an address for git) was read and upserted; progress is
    told each of the STEPS.

    The summary holds counts of files, lines, entities, relationships, created and known vertices and edges, languages,
    file types, warnings, the seconds taken, and insights (see insights.summaries)."""
    began = time.time()
    say = progress or (lambda n, step: None)
    name = source.rstrip("/").rsplit("/", 1)[-1].removesuffix(".git")
    say(1, STEPS[0])
    with readers.cloned(source, branch, commit) as (path, sha):
        say(2, STEPS[1])
        files = cut(local_files(spark, path, subdirectory).withColumns({"repository_name": F.lit(name), "repository_url": F.lit(source), "commit_sha": F.lit(sha)}), "files")
    by = files.groupBy("language", "file_type").agg(F.count("*").alias("n"), F.sum("line_count").alias("lines")).collect()  # a row a language
    say(3, STEPS[2])
    es, rs = extracted(files)
    say(4, STEPS[3])
    es, rs = cut(es, "entities"), cut(rs, "relationships")
    say(5, STEPS[4])
    new_v = cut(graph.vertices(es), "vertices")
    new_e = cut(graph.edges(rs, new_v), "edges")
    say(6, STEPS[5])
    counts = graph.ingest_counts(vertices, edges, new_v, new_e).first().asDict()
    all_v = graph.upsert_vertices(vertices, new_v)
    all_e = graph.upsert_edges(edges, new_e, all_v)
    say(7, STEPS[6])
    tally = lambda k: {x: sum(r.n for r in by if r[k] == x) for x in sorted({r[k] for r in by})}
    n = sum(r.n for r in by)
    summary = {
        "repository_name": name, "repository_url": source, "commit_sha": sha, "status": "COMPLETED", "files_scanned": n, "lines_scanned": sum(r.lines or 0 for r in by), "entities_extracted": new_v.count(), "relationships_extracted": new_e.count(),
        **counts, "languages": tally("language"), "file_types": tally("file_type"), "warnings": [] if n else ["no file that could be read"], "insights": insights.summaries(new_v, new_e, name), "duration_seconds": round(time.time() - began, 3),
    }
    return summary, all_v, all_e
