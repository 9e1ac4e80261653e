"""Hierarchies against a plain walk."""

import random

from strataloom.operators import hierarchy as H


def brute(links):
    up = {}
    for c, p in sorted(links, key=lambda x: (x[0], x[1])):
        up.setdefault(c, p)
    out = {}
    for c in up:
        seen, x = [], c
        while x in up and x not in seen:
            seen.append(x)
            x = up[x]
        if x in up:
            ring = seen[seen.index(x) :]
            out[c] = (min(ring, key=lambda s: s.encode()), -1)
        else:
            out[c] = (x, len(seen))
    return out


def test_random_forests_with_cycles(spark):
    rng = random.Random(7)
    links = [(f"n{i}", f"n{rng.randrange(max(1, i))}") for i in range(1, 120)]
    links += [(f"chain{i}", f"chain{i - 1}") for i in range(1, 40)] + [("c0", "c2"), ("c1", "c0"), ("c2", "c1"), ("below", "c1"), ("lower", "below"), ("d1", "d2"), ("d2", "d1"), ("é2", "é1")]
    df = spark.createDataFrame(links + links[:5], "child string, parent string")
    got = {r.node_id: (r.root_id, r.depth) for r in H.hierarchy(H.clean_links(df, "child", "parent")).collect()}
    assert got == brute(links)
    pairs = {(r.ancestor_id, r.node_id): r.distance for r in H.ancestor_pairs(H.clean_links(df, "child", "parent")).collect()}
    up = dict(links)
    want = {}
    for c, (_, depth) in brute(links).items():
        x, k = c, 0
        while depth > 0 and x in up:
            x, k = up[x], k + 1
            want[x, c] = k
    assert pairs == want
    paths = {r.node_id: r.path for r in H.full_paths(H.clean_links(df, "child", "parent"), "/").collect()}
    assert paths["chain3"] == "chain0/chain1/chain2/chain3" and paths["lower"] is None


def test_dirt_and_empty_tables(spark):
    schema = "source_canonical_id string, target_canonical_id string, relationship_type string, child string"
    rows = [("a", "b", " contains ", "x"), ("a", "b", "CONTAINS", "y"), (None, "c", "CONTAINS", "y"), ("a", " ", "CONTAINS", "y"), ("b", "b", "CONTAINS", "y"), ("b", "c", "USES", "y"), ("b", "d", None, "y"), ("b", "e", "Contains", None)]
    df = spark.createDataFrame(rows, schema)
    got = sorted(tuple(r) for r in H.hierarchy(H.contains_links(df)).collect())
    assert got == [("b", "a", 1), ("e", "a", 2)]
    empty = H.contains_links(df.limit(0))
    assert H.hierarchy(empty).count() == 0 and H.ancestor_pairs(empty).count() == 0 and H.descendant_counts(empty).count() == 0


def test_hot_parent(spark):
    df = spark.range(3000).selectExpr("concat('n', id) as child", "case when id % 3 = 0 then 'n1' else 'root' end as parent")
    got = H.hierarchy(H.clean_links(df, "child", "parent"))
    assert got.count() == 3000 and got.where("root_id <> 'root'").count() == 0


def test_one_root_over_all_nodes(spark, monkeypatch):
    from strataloom.operators import hierarchy, skew

    monkeypatch.setattr(hierarchy, "hot_limit", lambda rows: 5)
    links = spark.createDataFrame([(f"c{i}", "root") for i in range(40)] + [(f"d{i}", f"c{i % 2}") for i in range(40)] + [("x", "y"), ("y", "x")] + [(f"z{i}", "x") for i in range(9)], "child string, parent string")
    got = {r.node_id: (r.root_id, r.depth) for r in hierarchy.hierarchy(links).collect()}
    assert len(got) == 91 and got["c7"] == ("root", 1) and got["d7"] == ("root", 2) and got["x"] == ("x", -1) == got["z3"]
    assert skew.hot_limit(10**9) == 10**6


def test_further_parents_are_told(spark):
    from strataloom.operators import hierarchy

    df = spark.createDataFrame([("a", "p"), ("a", "q"), ("a", "q"), ("b", "p"), ("b", "b"), ("c", None), ("c", " ")], "child string, parent string")
    assert [tuple(r) for r in hierarchy.extra_parents(df, "child", "parent").collect()] == [("a", 2)]
