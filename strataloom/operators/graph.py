"""The property graph as two tables: vertices (id, label, name, ...) and edges (src, label, dst, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity, text
from . import merge
from .lineage import Cut, cut


def vertices(entities: DataFrame) -> DataFrame:
    """Merged entities as vertices; snippets to 400 characters, paths tidied."""
    m = merge.merge_code_entities(entities)
    p = F.col("provenance")
    return m.select(
        F.col("canonical_id").alias("id"),
        text.label("entity_type").alias("label"),
        text.one_line("name").alias("name"),
        "description",
        F.array_join("aliases", ", ").alias("aliases"),
        p["repository_name"].alias("repository_name"),
        p["repository_url"].alias("repository_url"),
        p["branch"].alias("branch"),
        p["commit_sha"].alias("commit_sha"),
        identity.tidy_path(p["file_path"]).alias("file_path"),
        p["start_line"].alias("start_line"),
        p["end_line"].alias("end_line"),
        text.truncate(text.one_line(p["source_snippet"]), 400).alias("source_snippet"),
        p["extraction_method"].alias("extraction_method"),
        "confidence",
        "properties",
    )


def edges(relationships: DataFrame, vs: DataFrame) -> DataFrame:
    """Merged relationships as edges, of which both ends exist."""
    m = merge.merge_relationships(relationships, "source_canonical_id", "target_canonical_id", "relationship_type", ["extracted_at", "record_id"])
    p = F.col("provenance")
    flat = m.select("src", "label", "dst", "weight", "description", p["repository_name"].alias("repository_name"), p["commit_sha"].alias("commit_sha"), identity.tidy_path(p["file_path"]).alias("file_path"), p["start_line"].alias("start_line"), p["end_line"].alias("end_line"), p["extraction_method"].alias("extraction_method"))
    return merge.prune_ends(flat, vs)


# -- upsert ----------------------------------------------------------------------------------------------------------


def upsert_vertices(old: DataFrame, new: DataFrame, replace_label: str | None = "Repository") -> DataFrame:
    """All vertices, the first writer of an id winning; those of ``replace_label`` take the new row's non-null values.

    The batch may repeat ids: its first row by content counts."""
    cols = old.columns
    one = new.groupBy("id").agg(*[F.min_by(c, F.struct(*[F.col(x) for x in cols if x not in ("id", "properties")])).alias(c) for c in cols if c != "id"])
    added = one.join(old.select("id"), "id", "left_anti")
    if replace_label:
        fresh = one.where(F.col("label") == replace_label).select("id", *[F.col(c).alias(f"__{c}") for c in cols if c != "id"], F.lit(True).alias("__new"))
        old = old.join(fresh, "id", "left").select(*[F.when(F.col("__new") & (F.col("label") == replace_label), F.coalesce(f"__{c}", c)).otherwise(F.col(c)).alias(c) if c not in ("id", "label") else F.col(c) for c in cols])
    return old.unionByName(added.select(*cols))


def upsert_edges(old: DataFrame, new: DataFrame, vs: DataFrame) -> DataFrame:
    """All edges by (src, label, dst); new ones need both ends and are no loops."""
    key = ["src", "label", "dst"]
    sound = merge.prune_ends(new.where("src <> dst").dropDuplicates(key), vs)
    return old.unionByName(sound.join(old.select(*key), key, "left_anti"), allowMissingColumns=True)


def ingest_counts(old_v: DataFrame, old_e: DataFrame, new_v: DataFrame, new_e: DataFrame) -> DataFrame:
    """(vertices_created, vertices_existing, edges_created, edges_existing) of a batch."""
    v = new_v.select("id").distinct().join(old_v.select("id", F.lit(True).alias("known")), "id", "left")
    key = ["src", "label", "dst"]
    e = new_e.where("src <> dst").select(*key).distinct().join(old_e.select(*key, F.lit(True).alias("known")), key, "left")
    both = v.select(F.lit("v").alias("kind"), "known").unionByName(e.select(F.lit("e").alias("kind"), "known"))
    n = lambda kind, new: F.count_if((F.col("kind") == kind) & (F.col("known").isNull() if new else F.col("known").isNotNull()))
    return both.agg(n("v", True).alias("vertices_created"), n("v", False).alias("vertices_existing"), n("e", True).alias("edges_created"), n("e", False).alias("edges_existing"))


# -- reads -----------------------------------------------------------------------------------------------------------


def with_ends(es: DataFrame, vs: DataFrame) -> DataFrame:
    """Edges with names and labels of both ends."""
    end = lambda p: vs.select(F.col("id").alias(p), F.col("name").alias(f"{p}_name"), F.col("label").alias(f"{p}_label"))
    return es.join(end("src"), "src").join(end("dst"), "dst")


def stats(vs: DataFrame, es: DataFrame) -> DataFrame:
    """(kind, label, n): vertices and edges by label."""
    return vs.groupBy("label").count().select(F.lit("vertex").alias("kind"), "label", F.col("count").alias("n")).unionByName(es.groupBy("label").count().select(F.lit("edge").alias("kind"), "label", F.col("count").alias("n")))


def degrees(vs: DataFrame, es: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of every vertex. Both directions are counted in one aggregation before the join."""
    ends = es.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    n = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return vs.select("id").join(n, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def neighbours(es: DataFrame, vs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, direction, label, other, other_name, other_label) of each edge at the given ids, both directions."""
    both = es.select(F.col("src").alias("id"), F.lit("out").alias("direction"), "label", F.col("dst").alias("other")).unionByName(es.select(F.col("dst").alias("id"), F.lit("in").alias("direction"), "label", F.col("src").alias("other")))
    return both.join(ids.select("id").distinct(), "id", "left_semi").join(vs.select(F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("label").alias("other_label")), "other")


def isolated(vs: DataFrame, es: DataFrame) -> DataFrame:
    """Vertices without an edge."""
    return vs.join(es.select(F.col("src").alias("id")).union(es.select(F.col("dst").alias("id"))), "id", "left_anti")


def repository_graph(vs: DataFrame, es: DataFrame, repository: str) -> tuple[DataFrame, DataFrame]:
    """A repository's vertices (its own, the ends of its edges, isolated ones) and edges."""
    own = es.where(F.col("repository_name") == repository)
    ends = own.select(F.col("src").alias("id")).union(own.select(F.col("dst").alias("id")))
    ids = vs.where(F.col("repository_name") == repository).select("id").union(ends).distinct()
    return vs.join(ids, "id", "left_semi"), own


def search(vs: DataFrame, label: str | None = None, text_: str | None = None) -> DataFrame:
    """Vertices by label and by a part of the name; both reach the scan before any limit."""
    out = vs.where(F.col("label") == label) if label else vs
    return out.where(F.lower("name").contains(text_.lower())) if text_ else out


def matching(column_names: list[str], token: str) -> Column:
    """Whether any of the columns holds the token as a word (or a file name with its dots taken as any character)."""
    clean = "".join(c for c in token if c not in "'\"\\").strip()
    if len(clean) < 2:
        return F.lit(False)
    word = clean.replace("_", "").isalnum()
    pattern = rf"(?i)\b{clean}\b" if word else "(?i)" + "".join(c if c.isalnum() or c in "_-" else "." for c in clean)
    out = F.lit(False)
    for c in column_names:
        out = out | F.coalesce(F.rlike(F.col(c), F.lit(pattern)), F.lit(False))
    return out


def k_hop(es: DataFrame, seeds: DataFrame, hops: int = 1, directed: bool = False) -> DataFrame:
    """(id, hop) of what the seeds reach in at most ``hops`` steps, with the least step.

    Level by level: a frontier joins the edges, what was seen before is left out, each level is written once."""
    step = es.select(F.col("src").alias("id"), F.col("dst").alias("to"))
    if not directed:
        step = step.union(es.select(F.col("dst").alias("id"), F.col("src").alias("to")))
    hold = Cut(es.sparkSession, "hops", keep=hops + 1)
    seen = frontier = hold(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
    for k in range(1, hops + 1):
        nearer = step.join(frontier.select("id"), "id", "left_semi").select(F.col("to").alias("id")).distinct()
        frontier = hold(nearer.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(k)))
        seen = seen.unionByName(frontier)
    return seen


def components(es: DataFrame, vs: DataFrame) -> DataFrame:
    """(id, component): the smallest id that a vertex is connected to, whatever the direction.

    Rounds go on until nothing changes; their number grows with the logarithm of the number of vertices.

    Large-star and small-star rounds: each replaces edges by links to smaller ids, so that hubs aren't expanded."""
    hold = Cut(es.sparkSession, "stars")
    links = hold(es.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    same = False
    while not same:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v")
        nxt = hold(small.distinct())
        same = nxt.exceptAll(links).isEmpty() and links.exceptAll(nxt).isEmpty()
        links = nxt
    return vs.select("id").join(links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("c")), "id", "left").select("id", F.coalesce("c", "id").alias("component"))


def document_subgraph(vs: DataFrame, es: DataFrame, by: str = "repository_name") -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of every value of ``by`` (a repository, a document): its own vertices with the ends of its edges,
    and its edges, each with a column scope. One plan for all of them; a vertex may be in several."""
    own = es.where(F.col(by).isNotNull()).withColumn("scope", F.col(by))
    ids = vs.where(F.col(by).isNotNull()).select(F.col(by).alias("scope"), "id").union(own.select("scope", F.explode(F.array("src", "dst")))).distinct()
    return ids.join(vs, "id").select("scope", *vs.columns), own


def provenance(vs: DataFrame, es: DataFrame, name: Column | str, limit: int = 50) -> DataFrame:
    """(id, name, file_path, start_line, source_snippet, direction, relationship, other, other_name, other_label) of the
    vertices whose id or name is ``name`` (a value, or a column of booleans over vertices), with at most ``limit``
    neighbours each, in the order of their ids. A vertex without neighbours has one row."""
    from pyspark.sql import Window

    hit = (F.col("id") == name) | (F.col("name") == name) if isinstance(name, str) else name
    found = vs.where(hit).select("id", "name", "file_path", "start_line", "source_snippet")
    near = neighbours(es, vs, found).withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("other", "label", "direction"))).where(F.col("k") <= limit)
    return found.join(near.select("id", "direction", F.col("label").alias("relationship"), "other", "other_name", "other_label"), "id", "left")


def subgraph_of(items: DataFrame, vs: DataFrame, es: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vertices and edges that ranked items (qid, item_id) stand for, each with qid: what a view of an answer draws.
    The ends of its edges are among the vertices. The items are written first: they are read twice here, and one plan that
    made a ranked list twice was seen to give a reader items beyond its limit (71 of 1,820 vertices at sf0.01)."""
    items = cut(items.select("qid", "item_id"), "items")
    part = F.split("item_id", r"\|")
    links = items.where(F.col("item_id").startswith("code:edge|")).select("qid", part[1].alias("src"), part[2].alias("label"), part[3].alias("dst"))
    links = links.join(es, ["src", "label", "dst"])
    ids = items.where(F.col("item_id").startswith("code:node:")).select("qid", F.substring("item_id", 11, 1 << 20).alias("id")).union(links.select("qid", F.explode(F.array("src", "dst")))).distinct()
    return ids.join(vs, "id"), links
