"""Leaks of evaluation items against brute force."""

import random

from strataloom.llm import leakage as L


def brute(docs, items, n=20):
    found = set()
    for i, t in items:
        w = L.words(t)
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for d, text in docs:
            x = L.words(text)
            if any(tuple(x[k : k + n]) in grams for k in range(len(x) - n + 1)):
                found.add((d, i))
    return found


def test_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(12)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([5, 19, 20, 60]))) for i in range(12)] + [(90, None), (91, ""), (92, "same " * 30)]
    docs = []
    for d in range(60):
        text = say(rng.randint(0, 40))
        i, t = rng.choice(items[:12])
        w = t.split()
        k = rng.choice([19, 20, 25])
        a = rng.randint(0, max(0, len(w) - k))
        docs.append((d, text + rng.choice([" ", "\n# ", "_"]) + rng.choice(["\n// ", "-", " "]).join(w[a : a + k]).upper() + " " + say(5)))
    docs += [(100, None), (101, ""), (102, "Same " * 25), (102, "same " * 25), (103, "same " * 19)]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 10
    got = [tuple(r) for r in L.leaks(a, b).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert set(tuple(r) for r in L.leaks(a, b.limit(0)).collect()) == set()
    assert L.leaks(a.limit(0), b).count() == 0
    assert sum(r.n_docs for r in L.leaked_items(a, b).collect()) == len(want) == sum(r.n_items for r in L.leaked_documents(a, b).collect())


def test_blocks(spark):
    b = spark.createDataFrame([(i, "a b c d") for i in range(10)], "item_id long, text string")
    assert [len(x) for x in L.blocks(b, "item_id", "text", 8)] == [2] * 5
