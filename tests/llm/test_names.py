"""Names: readings of single forms, tokens against brute force, and the linking of rows."""

import random
from itertools import combinations, permutations

import pytest

from strataloom.llm import names as N


@pytest.mark.parametrize("name", ["Katherine D. Ripehekijo", "Ripehekijo, Katherine D.", "RIPEHEKIJO Katherine D.", "Dr. Katherine D. Ripehekijo", "  katherine  d. ripehekijo"])
def test_orders_of_a_name(name):
    assert N.person(name) == ("ripehekijo", "katherine", "d")


def test_short_forms():
    assert N.person("K.D. Jalasahöxek") == ("jalasahoxek", "k", "d")
    assert N.person("Corozonazak Y.") == ("corozonazak", "y", "")
    assert N.person("susan.zofememolu") == ("zofememolu", "susan", "")
    assert N.person("") == ("", "", "") == N.person("Dr.")
    assert N.organisation("The Bank of Bajazigaha") == N.organisation("Bajazigaha Bk.") == ("bajazigaha", "bank", "")
    assert N.organisation("Jiguferibe-Railways, G.m.b.H.") == ("jiguferibe", "railways", "gmbh")


def test_given_names():
    assert [N.given(x) for x in ("ben", "suasn", "sussan", "kolya", "ottokar", "k", "jon")] == ["benjamin", "susan", "susan", "nikolai", "ottokar", "k", "jonathan"]


def test_alignment():
    assert N.alignment(["benjamin", "bosuwenetor"], ["bosuwenetr", "ben"]) == 0.5
    assert N.alignment(["k", "tetatibudu"], ["katherine", "tetatibudu"]) < 1
    assert N.alignment(["katherine", "tetatibudu"], ["christopher", "tetatibudu"]) >= 9


def damerau(a, b):
    return N._edits(a, b) <= 1 or (len(a) == len(b) and any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b for i in range(len(a) - 1)))


def test_neighbourhood_against_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(5, 8))) for _ in range(60)]
    tokens = {b: 100 + i for i, b in enumerate(base)}
    for b in base:
        i = rng.randrange(len(b) - 1)
        tokens.setdefault(rng.choice([b[:i] + b[i + 1 :], b[:i] + "z" + b[i:], b[:i] + "x" + b[i + 1 :], b[:i] + b[i + 1] + b[i] + b[i + 2 :]]), 1)
    df = spark.createDataFrame([("s", t, n) for t, n in tokens.items()], "scope string, token string, n long")
    linked = {r.token: r.centre for r in N.variants(df).collect()}
    assert set(linked) == set(tokens)
    for t in tokens:
        near = [u for u in tokens if (tokens[u], [-ord(c) for c in u]) > (tokens[t], [-ord(c) for c in t]) and (damerau(t, u) if min(len(t), len(u)) >= 5 else t == u)]
        assert bool(near) <= (linked[t] != t)


ROWS = [
    (1, "Benjamin Ledoniceshi", "Person"), (2, "Ledoniceshi, Ben", "PERSON"), (3, "B. Ledonicéshi", "person "), (4, "Benjamin T. Ledoniceshi", "Person"), (5, "Bennjamin Ledonicéshi", "Person"),
    (6, "Susan Ledoniceshi", "Person"), (7, "Katherine Tetatibudu", "Person"), (8, "Christopher Tetatibudu", "Person"), (9, "Benjamin Ledoniceshi", "Person"),
    (20, "Bajazigaha Bank", "Organization"), (21, "Bank of Bajazigaha", "Organisation"), (22, "BAJAZIGAHA BK. CO.", "organization"), (23, "Bajazigaha Systems", "Organization"), (24, "Bajuzigaha Bank Ltd", "Organization"),
    (30, "Benjamin Ledoniceshi", "Dataset"), (31, None, "Person"), (32, "", "Person"), (33, "Benjamin Ledoniceshi", None),
]


def test_rows(spark):
    df = spark.createDataFrame([(i, n, n, t, None if i % 2 else [], "z") for i, n, t in ROWS], "mention_id long, name string, canonical_name string, type string, aliases array<string>, entity string")
    got = [tuple(r) for r in N.linked_pairs(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == set(combinations((1, 2, 3, 4, 5, 9), 2)) | set(combinations((20, 21, 22, 24), 2))
    sizes = {r.mention_id: (r.entity_id, r.n_rows) for r in N.groups(df).collect()}
    assert sizes[5] == (1, 6) and sizes[24] == (20, 4) and sizes[6] == (6, 1) and 30 not in sizes and 32 not in sizes
    assert N.linked_pairs(df.limit(0)).count() == 0


def test_hot_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "PAIR_BLOCK", 7)
    df = spark.createDataFrame([(i, "Susan Zofememolu", "Susan Zofememolu", "Person", None) for i in range(40)], "mention_id long, name string, canonical_name string, type string, aliases array<string>")
    assert N.linked_pairs(df).distinct().count() == 40 * 39 // 2 == N.linked_pairs(df).count()


def test_assignment_against_permutations():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 5)
        m = rng.randint(n, 6)
        cost = [[rng.choice([0.0, 0.5, 0.6, 0.9, 9.0]) for _ in range(m)] for _ in range(n)]
        assert abs(N.assignment(cost) - min(sum(cost[i][j] for i, j in enumerate(p)) for p in permutations(range(m), n))) < 1e-9


def test_every_token_of_a_long_name_counts():
    words = [f"{c}{c}verylong{c}" for c in "abcdefghijklmnopqrst"]
    assert N.alignment(words, list(reversed(words))) == 0
    assert N.alignment(words, [*words[:-1], "elsewhere"]) >= 9
    assert N.alignment(words[:7], [*words[:6], "elsewhere"]) >= 9


def test_short_names_link_only_where_one_is_much_rarer(spark):
    df = spark.createDataFrame([("p", "hull", 900), ("p", "hall", 700), ("p", "hlal", 3), ("p", "hal", 1), ("p", "hill", 60)], "scope string, token string, n long")
    assert {r.token: r.centre for r in N.variants(df).collect()} == {"hull": "hull", "hall": "hall", "hlal": "hall", "hal": "hall", "hill": "hill"}


def test_abbreviated_kinds():
    assert [N.spelled_out(w) for w in ("anlt", "univ", "labs", "fdn", "rlys", "bajaz", "bank")] == ["analytics", "university", "laboratories", "foundation", "railways", "bajaz", "bank"]
