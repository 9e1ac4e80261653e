"""Parent-child links to full hierarchies: path, depth, root and descendants of each node, cycles told apart.

Level-wise frontier joins: the frontier of round k holds the nodes whose ancestor chain is known up to 2**k levels, and
one equi-join of the frontier with itself extends all chains to twice the length, so that a tree of depth d takes
log2(d) rounds, not d. A round that finishes no node has passed the deepest tree; what is then still unreached lies on a
cycle or below one. Nodes are joined by 128-bit digests, 16 bytes each, however long their ids are.

Every node has at most one parent, so each join matches a row with at most one row and nothing fans out. Nodes that have
arrived leave the rounds. A pointer that a third of all nodes share is found by a count before each join: rows of such
hot pointers stay where they are and meet a broadcast of their few targets (see skew), also where nodes meet the names
of their roots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import Cut, cut
from .skew import counted_join, hot_limit

BLANK = r"^[\s\x{00A0}]*$"


def key(col: F.Column | str) -> F.Column:
    """16-byte digest of an id."""
    return F.unhex(F.md5(col))


def clean_links(df: DataFrame, child: str, parent: str) -> DataFrame:
    """One row (child, parent) per child: null, blank and self links go, repeated rows count once.

    If a child has several parents against the contract, the smallest one in byte order counts; extra_parents() tells them."""
    c, p = F.col(child).cast("string"), F.col(parent).cast("string")
    return (
        df.select(c.alias("child"), p.alias("parent"))
        .where("child is not null and parent is not null and child <> parent")
        .where(~F.col("child").rlike(BLANK) & ~F.col("parent").rlike(BLANK))
        .groupBy("child")
        .agg(F.min("parent").alias("parent"))
    )


def contains_links(relationships: DataFrame) -> DataFrame:
    """CONTAINS rows of graph relationships as links from target (child) to source (parent)."""
    kind = F.upper(F.regexp_replace("relationship_type", r"^\s+|\s+$", ""))
    return clean_links(relationships.where(kind == "CONTAINS"), "target_canonical_id", "source_canonical_id")


def _step(moving: DataFrame, arrived: DataFrame | None, wanted: DataFrame | None, limit: int, hottest: int) -> DataFrame:
    """The moving nodes after a jump from their pointer to the pointer's pointer, and whether they have arrived.

    wanted: (ptr, n) of their pointers; none where no pointer can be a hot one."""
    ahead = lambda df, done: df.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"), F.lit(done).alias("done2"))
    known = ahead(moving, False) if arrived is None else ahead(moving, False).unionByName(ahead(arrived, True))
    jumped = moving.join(known, "ptr", "left") if wanted is None else counted_join(moving, wanted.join(known, "ptr", "left"), "ptr", limit, hottest)
    return jumped.select(
        "node",
        F.coalesce("ptr2", "ptr").alias("ptr"),
        (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"),
        (F.col("ptr2").isNull() | F.col("done2")).alias("done"),
    )


def _load(nodes: DataFrame, rows: int, limit: int, hold: Cut) -> tuple[DataFrame | None, int]:
    """(ptr, n) of the nodes' pointers and the n of the hottest; nothing where so few rows can have no hot one."""
    if rows <= limit:
        return None, rows
    wanted = hold(nodes.groupBy("ptr").agg(F.count("*").alias("n")))
    return wanted, wanted.agg(F.max("n")).first()[0]


def _join_nodes(nodes: DataFrame, targets: DataFrame, rows: int, limit: int, hold: Cut) -> DataFrame:
    """nodes with what their pointers lead to (targets, one row a ptr)."""
    wanted, hottest = _load(nodes, rows, limit, hold)
    return nodes.join(targets, "ptr") if wanted is None else counted_join(nodes, targets.join(wanted, "ptr"), "ptr", limit, hottest)


def _cycles(open_nodes: DataFrame, names: DataFrame, rounds: int) -> DataFrame:
    """(node, root_id): the smallest id on the cycle that each never-arriving node leads to.

    After 2**j >= n steps every pointer lies on its cycle, and the pointers are all of the cycles' nodes. The minimum
    over 2**j nodes ahead then covers each cycle once 2**j reaches its length; both by doubling."""
    spark = open_nodes.sparkSession
    hold, hold_pointers = Cut(spark, "cycle"), Cut(spark, "pointers")
    n = open_nodes.count()
    state = open_nodes.select("node", "ptr")
    while (1 << rounds) < n:
        ahead = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"))
        state = hold(_join_nodes(state, ahead, n, hot_limit(n), hold_pointers).select("node", F.col("next").alias("ptr")))
        rounds += 1
    on_cycle = state.select("ptr").distinct().withColumnRenamed("ptr", "node")
    ring = names.join(on_cycle, "node", "left_semi").select("node", F.col("parent_key").alias("ptr"), F.col("child").alias("least"))
    hold_ring = Cut(spark, "ring")
    ring = hold_ring(ring)
    m, j = ring.count(), 0
    while (1 << j) < m:
        ahead = ring.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"), F.col("least").alias("least2"))
        ring = hold_ring(ring.join(ahead, "ptr").select("node", F.col("next").alias("ptr"), F.least("least", "least2").alias("least")))
        j += 1
    least = ring.select(F.col("node").alias("ptr"), F.col("least").alias("root_id"))
    return _join_nodes(state, least, n, hot_limit(n), hold_pointers).select("node", "root_id")


def hierarchy(links: DataFrame, max_rounds: int = 62) -> DataFrame:
    """(node_id, root_id, depth) of each child in ``links`` (child, parent; one row per child, see clean_links).

    root_id is the topmost ancestor and depth the number of links to it. On a cycle or below one depth is -1 and root_id
    the smallest id on that cycle in byte order. An empty table gives an empty result."""
    spark = links.sparkSession
    names = cut(links.select("child", "parent", key("child").alias("node"), key("parent").alias("parent_key")), "links")
    hold = Cut(spark, "levels", keep=max_rounds)
    moving = names.select("node", F.col("parent_key").alias("ptr"), F.lit(1).alias("dist"))
    hold_pointers = Cut(spark, "pointers")
    total = names.count()
    limit, arrived, left, rounds = hot_limit(total), None, total, 0
    while left and rounds < max_rounds:
        wanted, hottest = _load(moving, left, limit, hold_pointers)
        state = hold(_step(moving, arrived, wanted, limit, hottest))
        done = state.where("done").drop("done")
        arrived = done if arrived is None else arrived.unionByName(done)
        moving = state.where("not done").drop("done")
        now, rounds = moving.count(), rounds + 1
        if now == left:  # a round that finishes no node has passed the deepest tree
            break
        left = now
    if arrived is None:
        return names.select(F.col("child").alias("node_id"), F.col("parent").alias("root_id"), F.lit(0).alias("depth")).where("false")
    tops = names.select(F.col("parent_key").alias("ptr"), F.col("parent").alias("root_id")).join(names.select(F.col("node").alias("ptr")), "ptr", "left_anti").distinct()
    done = _join_nodes(arrived, tops, total - left, limit, hold_pointers).select("node", "root_id", F.col("dist").alias("depth"))
    if left:
        done = done.unionByName(_cycles(moving, names, rounds).withColumn("depth", F.lit(-1)))
    return names.select("node", F.col("child").alias("node_id")).join(done, "node").select("node_id", "root_id", F.col("depth").cast("int").alias("depth"))


def extra_parents(df: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, n_parents) of each child with several parents, of which clean_links() keeps the smallest: what to report."""
    c, p = F.col(child).cast("string").alias("child"), F.col(parent).cast("string").alias("parent")
    sound = df.select(c, p).where("child is not null and parent is not null and child <> parent").where(~F.col("child").rlike(BLANK) & ~F.col("parent").rlike(BLANK))
    return sound.distinct().groupBy("child").agg(F.count("*").alias("n_parents")).where("n_parents > 1")


def ancestor_pairs(links: DataFrame, max_rounds: int = 62) -> DataFrame:
    """(ancestor_id, node_id, distance): each node with each of its ancestors, by doubling of the pairs known so far.

    Round k joins pairs of distance 2**k exactly with all shorter ones, so every pair is made once. Nodes on a cycle or
    below one are left out: their ancestors have no end. The output is as large as the sum of all depths."""
    trees = hierarchy(links).where("depth > 0").select(F.col("node_id").alias("child"))
    sound = cut(links.join(trees, "child", "left_semi").select(F.col("child").alias("node_id"), F.col("parent").alias("ancestor_id")), "sound")
    hold_pairs, hold_jump = Cut(links.sparkSession, "pairs", keep=0), Cut(links.sparkSession, "jumps", keep=0)
    pairs, jump, k = sound.withColumn("distance", F.lit(1)), sound, 0
    while k < max_rounds and not jump.isEmpty():
        step = jump.select(F.col("node_id").alias("low"), F.col("ancestor_id").alias("node_id"))
        longer = pairs.join(step, "node_id").select(F.col("low").alias("node_id"), "ancestor_id", (F.col("distance") + (1 << k)).alias("distance"))
        pairs = hold_pairs(pairs.unionByName(longer))
        jump = hold_jump(jump.join(jump.select(F.col("node_id").alias("ancestor_id"), F.col("ancestor_id").alias("top")), "ancestor_id").select("node_id", F.col("top").alias("ancestor_id")))
        k += 1
    return pairs.select("ancestor_id", "node_id", "distance")


def full_paths(links: DataFrame, sep: str = " > ") -> DataFrame:
    """(node_id, path, depth): ids from the root down to each tree node, joined by ``sep``; path is null on cycles."""
    tree = hierarchy(links)
    pairs = ancestor_pairs(links)
    up = pairs.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor_id"))).alias("up"))
    path = F.concat_ws(sep, F.transform("up", lambda x: x["ancestor_id"]), F.col("node_id"))
    return tree.join(up.select("node_id", path.alias("path")), "node_id", "left").select("node_id", "path", "root_id", "depth")


def descendant_counts(links: DataFrame) -> DataFrame:
    """(node_id, descendants, height) of each node that has any, cycles left out."""
    return ancestor_pairs(links).groupBy(F.col("ancestor_id").alias("node_id")).agg(F.count("*").alias("descendants"), F.max("distance").alias("height"))
