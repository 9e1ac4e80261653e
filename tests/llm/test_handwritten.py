"""Generated, minified, vendored and data files: cases, and shared trees against brute force."""

import random
from collections import defaultdict

import pytest

from strataloom.llm import handwritten as H

OWN = 'import os\nimport re\n\n\ndef scan_{0}(glacier, voucher={1}):\n    """Nothing here depends on the manifest {0}."""\n    pivot = []\n    for item in glacier:\n        if item.get("receipt") and len(pivot) < voucher:\n            pivot.append(item["receipt"])\n    return pivot\n\n\ndef render_{0}(sink, tariff):\n    if not sink:\n        return None\n    return [x ** {1} for x in sink if x not in (tariff or ())]\n'
STUB = "public final class BadgeStub {\n" + "".join(f"    private int f{i}_;\n    public int getField{i}() {{ return f{i}_; }}\n" for i in range(9)) + "}\n"
MINI = "!function(t,e){" + "".join(f'function x{i}(a,b){{return a?b+{i}:a-b}}t.k{i}=x{i};' for i in range(30)) + "}(window);"


@pytest.mark.parametrize(
    "path,text,kind",
    [
        ("a/x.go", "// Code generated by apicast 2.17. DO NOT EDIT.\n\npackage x\n", "generated"),
        ("a/x.ts", "// -----\n// This file was created automatically by lexloom; manual changes will be lost.\n// -----\nexport const a = 1;\n", "generated"),
        ("a/x.py", "# Fichier généré par tidegen 1.14 : ne pas modifier\nx = 1\n", "generated"),
        ("a/BadgeStub.java", STUB, "generated"),
        ("a/x.js", MINI, "minified"),
        ("data_x.py", "DATA = [" + ", ".join(str(i * 7919 % 1013) for i in range(400)) + "]\n", "data"),
        ("third_party/vapupax/lib/x.py", OWN.format("q", 3), "vendored"),
        ("utils/x.py", "# Copied verbatim from mosejujs@08c247e; local patch: none\n" + OWN.format("q", 3), "vendored"),
        ("utils/x.py", "# Copyright (c) 2014 the tovebikit authors. ISC licence.\n" + OWN.format("q", 3), "vendored"),
        ("utils/x.py", "# Copyright (c) 2025 this project's contributors. Licensed as stated in LICENSE.\n" + OWN.format("q", 3), None),
        ("marketplace/vendor/x.py", OWN.format("q", 3), None),
        ("tools/codegen.py", OWN.format("q", 3) + '\nHEADER = "// Code generated by codegen. DO NOT EDIT."\n', None),
        ("README.md", "<!-- generated by x, do not edit -->\n", None),
        ("a.py", "", None),
    ],
)
def test_kinds(path, text, kind):
    assert H.kind_of(path, text, "repo-a") == kind


def rows(spark, data):
    return spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, repository_name string, file_path string, kind string")


def test_copies(spark):
    lib = OWN.format("lib", 77)
    data = [
        (1, lib, "a", "common/x.py"), (2, "# mine\n\n" + lib.replace("\n", "\r\n"), "b", "src/y.py"), (3, OWN.format("own", 5), "a", "src/own.py"), (4, OWN.format("own", 5), "a", "src/own.py"),
        (5, OWN.format("two", 9), "a", "src/two.py"), (6, None, "a", "src/n.py"), (7, "", "b", "src/e.py"), (8, lib, "b", None), (9, lib[: len(lib) * 4 // 5], "c", ".\\lib\\z.py"),
        (10, "502 Bad Gateway\n\nThe server could not handle the request for this file.\n", "a", "q.py"), (11, "502 Bad Gateway\n\nThe server could not handle the request for this file.\n", "b", "q.py"),
    ]
    got = {r.doc_id: r.kind for r in H.classified(rows(spark, data)).collect()}
    assert got == {1: "vendored", 2: "vendored", 9: "vendored"}
    assert {r.doc_id for r in H.handwritten(rows(spark, data)).collect()} == {3, 4, 5, 10, 11}
    assert H.classified(rows(spark, data).limit(0)).count() == 0


def test_trees_against_brute_force(spark):
    rng = random.Random(1)
    files = [(repo, "/".join(rng.choice("pq") for _ in range(rng.randint(0, 3))) + f"/f{rng.randint(0, 1)}.py", rng.randint(0, 1)) for repo in "abcd" for _ in range(9)]
    files = [(r, p.lstrip("/"), h) for r, p, h in files]
    df = spark.createDataFrame(files, "repo string, path string, file_hash long")
    trees = defaultdict(dict)
    for r, p, h in files:
        parts = p.split("/")
        for k in range(1, len(parts)):
            t = trees[r, "/".join(parts[:k])]
            t["/".join(parts[k:])] = max(h, t.get("/".join(parts[k:]), 0))
    by = defaultdict(set)
    for (r, d), t in trees.items():
        if len(t) >= 2:
            by[tuple(sorted(t.items()))].add((r, d))
    want = {x for g in by.values() if len({r for r, _ in g}) > 1 for x in g}
    assert {(r.repo, r.dir) for r in H.shared_trees(df).collect()} == want


def test_trees_of_any_depth(spark):
    deep = "/".join(f"d{i}" for i in range(30))
    rows = [(r, f"{top}/{deep}/{f}.py", h) for r, top in (("a", "x"), ("b", "y/z")) for f, h in (("f", 1), ("g", 2))] + [("b", f"y/z/{deep}/d30/h.py", 3), ("a", "x/own.py", 4)]
    df = spark.createDataFrame(rows, "repo string, path string, file_hash long")
    assert {(r.repo, r.dir) for r in H.shared_trees(df).collect()} == set()
    df = df.where("file_hash <> 3")
    assert ("a", f"x/{deep}") in {(r.repo, r.dir) for r in H.shared_trees(df).collect()} and len(H.shared_trees(df).collect()) == 2 * 30
    assert H.shared_trees(df.limit(0)).count() == 0


def test_newest_scan_of_a_path_counts(spark):
    rows = [("a", "v/f.py", 1, 10), ("a", "v/f.py", 9, 5), ("a", "v/g.py", 2, 10), ("b", "w/f.py", 1, 1), ("b", "w/g.py", 2, 1)]
    df = spark.createDataFrame(rows, "repo string, path string, file_hash long, at long")
    assert {(r.repo, r.dir) for r in H.shared_trees(df).collect()} == {("a", "v"), ("b", "w")}


def test_hashes_are_asked_of_every_file(spark):
    lib = OWN.format("lib", 77)
    head = "// Code generated by apicast 2.17. DO NOT EDIT.\n\n"
    data = [(1, "# Copied verbatim from mosejujs@08c247e\n" + lib, "a", "third_party/q/x.py"), (2, lib, "b", "src/y.py"), (3, head + "package x\n", "a", "x.go"), (4, "# " + "licence text\n# " * 60 + "Code generated by x. DO NOT EDIT.\n" + OWN.format("z", 1), "a", "z.py")]
    got = {r.doc_id: (r.kind, r.evidence) for r in H.classified(rows(spark, data)).collect()}
    assert got == {1: ("vendored", ["alone", "block", "file"]), 2: ("vendored", ["block", "file"]), 3: ("generated", ["alone"]), 4: ("generated", ["alone"])}


def test_trees_across_partitions(spark):
    rng = random.Random(7)
    files = {(repo, "/".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) + f"/f{rng.randint(0, 3)}"): rng.randint(0, 9) for repo in "xyz" for _ in range(400)}
    rows = [(r, p, h) for (r, p), h in files.items()]
    df = spark.createDataFrame(rows, "repo string, path string, file_hash long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = {}
    for ways in ("1", "3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", ways)
        try:
            trees = H.tree_hashes(df).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        got[ways] = {(t.repo, t.dir): (t.tree, t.n) for t in trees}
        assert len(got[ways]) == len(trees)
    assert got["1"] == got["3"] == got["40"]
    for (repo, d), (_, n) in got["1"].items():
        assert n == sum(r == repo and p.startswith(d + "/") for r, p in files)
    assert {(r, "/".join(p.split("/")[:k])) for r, p in files for k in range(1, p.count("/") + 1)} == set(got["1"])
