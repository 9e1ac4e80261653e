"""Merging, upserts, traversal and the Cypher subset on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from strataloom.operators import graph, insights, merge, retrieval
from strataloom.plans.cypher import CypherError, CypherGraph
from strataloom.plans.engine import ContextEngine, ask

V = "id string, label string, name string, description string, aliases string, repository_name string, repository_url string, commit_sha string, file_path string, start_line int, end_line int, source_snippet string, confidence double, properties map<string,string>"
E = "src string, label string, dst string, weight double, description string, repository_name string, commit_sha string, file_path string, start_line int"


def v(i, label, name, path="", desc=None, props=None):
    return (i, label, name, desc, "", "r", "https://h/o/r", "c1", path, 1, 20, None, 1.0, props or {})


def e(a, k, b, w=1.0):
    return (a, k, b, w, None, "r", "c1", "", 1)


@pytest.fixture(scope="module")
def g(spark):
    vs = [v("repo:r", "Repository", "r"), v("f1", "File", "auth.py", "auth.py", "Login and token checks"), v("f2", "File", "db.py", "db.py"), v("c1", "Class", "TokenStore", "auth.py"), v("m1", "Method", "verify_token", "auth.py"), v("l1", "Library", "fastapi"), v("a1", "API", "POST /login"), v("x", "Concept", "Lonely")]
    es = [e("repo:r", "CONTAINS", "f1"), e("repo:r", "CONTAINS", "f2"), e("f1", "DEFINES", "c1"), e("c1", "CONTAINS", "m1"), e("f1", "IMPORTS", "l1", 1.5), e("f2", "IMPORTS", "l1"), e("a1", "IMPLEMENTED_BY", "m1")]
    return spark.createDataFrame(vs, V), spark.createDataFrame(es, E)


def test_merge_rules(spark):
    rows = [(1, "pg", "PostgreSQL", "Concept", "db", ["PG"], 0.5), (2, "Postgres", "PostgreSQL", "Technology", "a database", None, 0.9), (3, "PostgreSQL", "PostgreSQL", "Concept", "a databasf", ["pg"], 0.1), (4, "x", None, "Concept", None, [], None)]
    m = merge.merge_entities(spark.createDataFrame(rows, "ord int, name string, canonical_name string, type string, description string, aliases array<string>, confidence double"), "canonical_name", ["ord"]).collect()
    assert len(m) == 1 and (m[0]["name"], m[0].type, m[0].description, m[0].aliases, m[0].confidence, m[0].mentions) == ("pg", "Technology", "a database", ["PG", "pg"], 0.9, 3)
    r = spark.createDataFrame([(1, "a", "b", "depends on", 1.0, None), (2, "a", "b", "DEPENDS_ON", 1.0, "d"), (3, "a", "a", "USES", 1.0, None), (4, None, "b", "USES", 1.0, None)], "ord int, s string, t string, k string, weight double, description string")
    got = merge.merge_relationships(r, "s", "t", "k", ["ord"]).collect()
    assert [(x.src, x.label, x.dst, x.weight, x.description) for x in got] == [("a", "DEPENDS_ON", "b", 1.5, "d")]


def test_ends(spark):
    es = spark.createDataFrame([("A", ["x", "Y"]), ("B", None)], "canonical_name string, aliases array<string>")
    rel = spark.createDataFrame([("y", "B"), ("postgres", "A")], "source_entity string, target_entity string")
    assert {tuple(r) for r in merge.resolve_ends(rel, es).select("source_entity", "target_entity").collect()} == {("A", "B"), ("PostgreSQL", "A")}
    made = merge.create_ends(spark.createDataFrame([("A", "new")], "src string, dst string"), es.withColumns({"name": F.col("canonical_name"), "type": F.lit("T"), "confidence": F.lit(1.0)}))
    assert {(r.canonical_name, r.type, r.confidence) for r in made.collect()} == {("A", "T", 1.0), ("B", "T", 1.0), ("new", "Concept", 0.8)}


def test_upserts_are_idempotent(spark, g):
    vs, es = g
    none_v, none_e = vs.limit(0), es.limit(0)
    assert tuple(graph.ingest_counts(none_v, none_e, vs, es).first()) == (8, 0, 7, 0)
    once_v, once_e = graph.upsert_vertices(none_v, vs), graph.upsert_edges(none_e, es, vs)
    assert tuple(graph.ingest_counts(once_v, once_e, vs, es).first()) == (0, 8, 0, 7)
    assert graph.upsert_vertices(once_v, vs).count() == 8 and graph.upsert_edges(once_e, es.union(es), vs).count() == 7
    newer = spark.createDataFrame([v("repo:r", "Repository", "renamed"), v("f1", "File", "other.py")], V)
    names = {r.id: r["name"] for r in graph.upsert_vertices(once_v, newer).collect()}
    assert names["repo:r"] == "renamed" and names["f1"] == "auth.py"


def test_traversal_and_insights(g):
    vs, es = g
    assert {r.id for r in graph.isolated(vs, es).collect()} == {"x"}
    assert {r.id: r.hop for r in graph.k_hop(es, vs.where("id = 'f2'"), 2).collect()} == {"f2": 0, "repo:r": 1, "l1": 1, "f1": 2}
    assert {r.id: (r.in_degree, r.out_degree) for r in graph.degrees(vs, es).collect()}["f1"] == (1, 2)
    top = insights.important_files(vs, es).orderBy(F.desc("importance")).first()
    assert top.id == "f1" and top.importance == 3 + 2 * 1 + 2 + 0.2
    assert [r.members for r in insights.class_methods(vs, es).collect()] == [["verify_token"]]
    assert [(r.http_method, r.endpoint) for r in insights.apis(vs).collect()] == [("POST", "/login")]
    assert "1 API routes" in insights.summaries(vs, es, "r")["interface"]
    assert ask(vs, es, "r", "entity_search", "token").count() == 2 and ask(vs, es, "r", "tech_stack").first()["name"] == "fastapi"


def test_components_against_union_find(spark):
    rng = random.Random(4)
    ids = [f"n{i:03d}" for i in range(120)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(70)] + [("n000", i) for i in ids[60:80]]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    es = spark.createDataFrame(pairs, "src string, dst string")
    got = {r.id: r.component for r in graph.components(es, spark.createDataFrame([(i,) for i in ids], "id string")).collect()}
    assert got == {i: find(i) for i in ids}


def test_cypher(g):
    q = CypherGraph(*g).query
    assert [r.n for r in q("MATCH (f:File)-[:IMPORTS]->(l:Library {name: 'fastapi'}) RETURN count(f) AS n").collect()] == [2]
    assert [tuple(r) for r in q("MATCH (a)<-[r:DEFINES]-(b) RETURN b.name, label(a) AS l").collect()] == [("auth.py", "Class")]
    assert q("MATCH (a)-[r]-(b) WHERE a.id = 'f1' RETURN b.id AS id").count() == 4 - 1
    assert [r.id for r in q("MATCH (n) WHERE n.name CONTAINS 'py' AND NOT (n.id IN ['f2'] OR n.id IS NULL) RETURN n.id AS id ORDER BY id DESC LIMIT 3").collect()] == ["f1"]
    assert q("MATCH (r:Repository)-[:CONTAINS]->(f)-[d:DEFINES]->(c) RETURN c.name AS c").first().c == "TokenStore"
    for bad in ("MATCH (a), (b) RETURN a.id AS x", "MATCH (a)-[*1..3]->(b) RETURN a.id AS x", "MERGE (a)", "MATCH (a) RETURN b.id AS x", "MATCH (a) RETURN a.id AS x LIMIT"):
        with pytest.raises(CypherError):
            q(bad)


def test_engine(spark, g):
    vs, es = g
    passages = spark.createDataFrame([("c1", "The login endpoint verifies a JWT token."), ("c2", "Snow fell on the hills."), ("c3", None)], "pid string, text string")
    engine = ContextEngine(vs, es, passages)
    a = engine.query("How does login verify tokens?")
    assert a.analysis["intent"] == "authentication" and a.stats["returned"] > 2 and "TokenStore" in a.context and a.citations and a.stats["chunks"] == 1
    assert engine.query("quasar zebra umbrella").items == []
    assert engine.query("How does login verify tokens?", mode="semantic").stats["nodes"] == 0


def test_bm25_against_plain(spark):
    import math

    docs = {"a": "alpha beta beta gamma", "b": "alpha delta", "c": "", "d": "beta whole phrase here"}
    q = spark.createDataFrame([(1, "whole phrase", ["whole", "phrase"]), (2, "x", ["beta", "nothing"]), (3, "y", [])], "qid int, query string, terms array<string>")
    got = {(r.qid, r.pid): r.score for r in retrieval.bm25(spark.createDataFrame(list(docs.items()), "pid string, text string"), q, 10, normalise=False).collect()}
    toks = {k: t.split() for k, t in docs.items()}
    avg = sum(map(len, toks.values())) / 4

    def score(t, d):
        df = sum(t in x for x in toks.values())
        tf = toks[d].count(t)
        return math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks[d]) / avg)) if tf else 0

    want = {(1, "d"): score("whole", "d") + score("phrase", "d") + 3, (2, "a"): score("beta", "a"), (2, "d"): score("beta", "d")}
    assert got == {k: round(x, 4) for k, x in want.items()}


def test_budget_and_keep_first(spark):
    rows = [(1, i + 1, f"i{i}", c) for i, c in enumerate(["a" * 400, "b" * 400, "A" * 400, "c" * 2000, "d" * 40])]
    df = spark.createDataFrame(rows, "q int, rank int, item_id string, content string")
    got = [(r["rank"], r.taken, len(r.shown or "")) for r in retrieval.within_budget(df, 400, ["q"]).orderBy("rank").collect()]
    assert got == [(1, True, 400), (2, True, 400), (3, True, 400), (4, True, 400), (5, False, 0)]
    assert retrieval.keep_first(df, ["q"]).first().kept == ["i0", "i1", "i3", "i4"]


def test_vectors_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8)).astype("float32")
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)] + [(100, None), (101, [0.0] * 8)], "vec_id long, embedding array<float>")
    got = retrieval.vector_top_k(df, df.where("vec_id % 20 = 0"), 5, block=2).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 20, 40):
        want = [i for i in np.argsort(-(u @ u[q])) if i != q][:5]
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_changes_through_cypher(spark, g):
    q = CypherGraph(*g)
    more = q.mutate("CREATE (n:Concept {id: 'c9', name: 'New', colour: 'red'})").mutate("MATCH (a {id: 'f1'}), (b {id: 'c9'}) CREATE (a)-[:DESCRIBES {weight: 0.5}]->(b)")
    assert [tuple(r) for r in more.query("MATCH (a)-[r:DESCRIBES]->(b:Concept) RETURN a.id AS a, b.colour AS c, r.weight AS w").collect()] == [("f1", "red", 0.5)]
    again = more.mutate("CREATE (n:Concept {id: 'c9', name: 'Other'})").mutate("MATCH (a {id: 'f1'}), (b {id: 'c9'}) CREATE (a)-[:DESCRIBES]->(b)")
    assert again.vertices.count() == more.vertices.count() and again.edges.count() == more.edges.count()
    assert more.mutate("MATCH (a {id: 'f1'}), (b {id: 'nowhere'}) CREATE (a)-[:USES]->(b)").edges.count() == more.edges.count()
    changed = again.mutate("MATCH (n:Concept) SET n.name = 'Renamed', n.colour = null, n.size = 3").query("MATCH (n:Concept {id: 'c9'}) RETURN n.name AS n, n.colour AS c, n.size AS s").first()
    assert tuple(changed) == ("Renamed", None, "3")
    for bad in ("CREATE (n:Concept {name: 'x'})", "MATCH (a) SET a.id = 'x'", "MATCH (a {id: 'f1'}) CREATE (a)-[:X]->(b)", "MATCH (a)-[r]->(b) CREATE (a)-[:X]-(b)"):
        with pytest.raises(CypherError):
            q.mutate(bad)


def test_scopes_and_stages(spark, g):
    vs, es = g
    passages = spark.createDataFrame([("p1", "the login endpoint verifies a token", "r1", None, None), ("p2", "another login endpoint verifies a token token", "r2", None, None), ("p3", "login token of a page", None, "d1", "Guide.pdf")], "pid string, text string, repository_name string, document_id string, document_name string")
    engine = ContextEngine(vs, es, passages)
    ask_ = lambda **k: [i["item_id"] for i in engine.query("How does login verify tokens?", mode="semantic", **k).items]
    assert ask_(repository="r1") == ["p1"] and ask_(document_name="guide.PDF") == ["p3"] and set(ask_()) == {"p1", "p2", "p3"}
    assert set(ask_(repository="r2", document_id="d1")) == {"p2", "p3"} and ask_(document_id="nowhere") == []
    from strataloom.operators import retrieval

    def broken(*a, **k):
        raise RuntimeError("index lost")

    kept, retrieval.bm25 = retrieval.bm25, broken
    try:
        a = engine.query("How does login verify tokens?")
    finally:
        retrieval.bm25 = kept
    assert a.items and a.stats["errors"] == ["passages: RuntimeError: index lost"] and a.stats["chunks"] == 0 and a.stats["total_candidates"] >= a.stats["returned"]
    assert engine.query("").items == [] and engine.status()["passages"] == 3


def test_document_graph_and_its_edges(spark, g):
    vs = spark.createDataFrame([("Harbor", "Concept", "Harbor", "a port", "", "d1", "Guide.pdf", 2, "the Harbor is old"), ("Crane", "Concept", "Crane", None, "", "d2", "Other.pdf", 1, None)], "id string, label string, name string, description string, aliases string, document_id string, document_name string, page_number int, source_text string")
    es = spark.createDataFrame([("Harbor", "USES", "Crane", 1.0, "lifts freight", "d1", "Guide.pdf", 2, "freight is lifted")], "src string, label string, dst string, weight double, description string, document_id string, document_name string, page_number int, source_text string")
    engine = ContextEngine(*g, spark.createDataFrame([], "pid string, text string"), vs, es)
    items = {i["item_id"]: i for i in engine.query("Where is the Harbor?", mode="graph").items}
    assert items["document:node:Harbor"]["page_number"] == 2 and "document:edge|Harbor|USES|Crane" in items
    assert [i["item_id"] for i in engine.query("Is freight moved?", mode="graph", document_id="d1").items] == []  # its other end is of another document
    assert [i["item_id"] for i in engine.query("Is freight moved?", mode="graph").items] == ["document:edge|Harbor|USES|Crane"]
    assert engine.query("Where is the Harbor?", mode="graph", document_name="Other.pdf").items == []


def test_hot_and_cold_keys_join_alike(spark):
    from strataloom.operators import skew

    big = spark.createDataFrame([(i, "h" if i % 3 else f"k{i}") for i in range(90)] + [(99, None)], "i int, k string")
    small = spark.createDataFrame([("h", 60, "x")] + [(f"k{i}", 1, f"y{i}") for i in range(0, 90, 3)] + [("unused", 0, "z")], "k string, n long, v string")
    want = {tuple(r) for r in big.join(small.drop("n"), "k").select("i", "v").collect()}
    for limit in (10, 1000):
        got = [tuple(r) for r in skew.counted_join(big, small, "k", limit, 60).select("i", "v").collect()]
        assert len(got) == len(want) == 90 and set(got) == want
    assert {tuple(r) for r in skew.salted_join(big, small.drop("n"), ["k"], ["i"], ways=4).select("i", "v").collect()} == want


def test_properties_of_a_shared_id(spark):
    from strataloom.operators import merge

    rows = [("lib:x", f"n{i}", "Library", None, {"version": "" if i == 0 else str(i), f"k{i % 3}": "v"}, [f"a{i % 2}"], 1.0, i, i) for i in range(20)] + [("lib:y", "y", "Library", None, None, None, 0.5, 1, 99)]
    df = spark.createDataFrame([(*r[:5], (None,), *r[5:7], r[7], r[8]) for r in rows], "canonical_id string, name string, entity_type string, description string, properties map<string,string>, provenance struct<file_path:string>, aliases array<string>, confidence double, extracted_at long, record_id long")
    got = {r.canonical_id: r for r in merge.merge_code_entities(df).collect()}
    assert got["lib:x"].properties == {"version": "1", "k0": "v", "k1": "v", "k2": "v"} and got["lib:x"].aliases == ["a0", "a1"] and got["lib:x"].n_records == 20
    assert got["lib:y"].properties == {} and got["lib:y"].aliases == []
