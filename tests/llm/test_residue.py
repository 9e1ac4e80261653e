"""Template residue and error pages: cases, and the classifier on repositories that it hasn't seen."""

import zlib

import numpy as np
import pytest

from strataloom.llm import residue as R

FOUND = [
    "502 Bad Gateway\n\nThe server could not handle the request for this file.\n",
    "<html>\n<head><title>503 Service Unavailable</title></head>\n<body>\n<center><h1>503 Service Unavailable</h1></center>\n<hr><center>cdn-node</center>\n</body>\n</html>\n",
    '<!DOCTYPE html><html><body><noscript>JavaScript est requis pour afficher cette page.</noscript><div id="root"></div></body></html>',
    '{\n  "error": {\n    "code": 503,\n    "reason": "Service Unavailable",\n    "request_id": "fc8745a9a406"\n  }\n}\n',
    "Please enable JavaScript and cookies to continue\n",
    '{\n  "name": "FIXME_AUTHOR",\n  "version": "0.0.0",\n  "description": "$title$",\n  "author": "[Your usage]"\n}\n',
    '"""${PROJECT_SUMMARY}"""\n\n__title__ = "%%DESCRIPTION%%"\n__author__ = "<INSERT PACKAGE HERE>"\n\ndef main():\n    """[Your package]"""\n    pass\n',
    "# Badge\n\nLorem ipsum dolor lectus sit augue porta ipsum dolor felis augue.\n\n## Flush Broker\n\nTODO: write this section\n\n{{ cookiecutter.title }}\n",
]
CLEAN = [
    'export function notFound(res) {\n  res.status(404).send("<h1>404 Not Found</h1>");\n  return res.end();\n}\n',
    "# Guide\n\nA 502 Bad Gateway means that the grid is not running. Between two updates the map stays nightly.\n\nWrite `{{ schedule }}` where the value should go.\n",
    'def greet(user):\n    tpl = "Dear {{ name }}, your vector is ready"\n    return tpl.replace("{{ name }}", user)\n\n\nsample = "lorem ipsum dolor sit amet"\nprint(len(sample), greet("x"))\n',
    'services:\n  db:\n    image: redis:7\n    environment:\n      POSTGRES_PASSWORD: "${POSTGRES_PASSWORD}"\n      SESSION_SECRET: "${SESSION_SECRET:?unset}"\n',
    "",
    "   \n",
]


def docs(spark):
    rows = [(i, t, f"r{i % 7}") for i, t in enumerate(FOUND * 6)] + [(1000 + i, t, f"r{i % 7}") for i, t in enumerate(CLEAN * 8)] + [(5000, None, None)]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, repository_name string, kinds string")


def test_cases(spark):
    got = {r.doc_id for r in R.residue(docs(spark)).collect()}
    assert got == set(range(len(FOUND) * 6))
    kept = {r.doc_id for r in R.without_residue(docs(spark)).collect()}
    assert 5000 in kept and len(kept) == len(CLEAN) * 8 + 1


def test_unseen_hosts(spark):
    all_kinds, *others = R.validation(docs(spark)).collect()
    assert all_kinds.left_out is None and (all_kinds.rows == 0 or all_kinds.recall == 1)
    assert [r.left_out for r in others] == list(R.KINDS)


def test_rows_come_from_the_classifier(spark, monkeypatch):
    monkeypatch.setattr(R, "_taught", lambda rows: np.array([0.0] * (1 << R.BITS) + [-9.0]))
    assert R.residue(docs(spark)).count() == 0
    gone = {(r.score, r.passed): r.n for r in R.effects(docs(spark)).collect()}
    assert gone[("low", True)] == len(FOUND) * 6 and not any(k[0] != "low" for k in gone)


def test_the_check_decides_doubtful_ones_only(spark, monkeypatch):
    for intercept, want in ((0.0, len(FOUND) * 6), (9.0, len(FOUND) * 6 + 8 * 4)):
        monkeypatch.setattr(R, "_taught", lambda rows, i=intercept: np.array([0.0] * (1 << R.BITS) + [i]))
        assert R.residue(docs(spark)).count() == want


def test_empty_table(spark):
    assert R.residue(docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("text", FOUND)
def test_weak_labels(text):
    assert R.weak_label(R.shares(text)) == 1


@pytest.mark.parametrize("text", CLEAN[:4])
def test_weak_negatives(text):
    assert R.weak_label(R.shares(text)) in (0, None) and R.shares(text)[0] < R.shares(text)[1]


def test_words_alone_find_a_page_without_a_phrase(spark):
    pages = [f"<html>\n<title>{c} Bad Gateway</title>\n<h1>Bad Gateway, harbor edge relay node {n}</h1>\n<p>Bad Gateway at the edge upstream of harbor relay</p>\n</html>" for c in (502, 504) for n in range(20)]
    own = [f"def area_{n}(width, height):\n    total = width * height\n    return total + {n}\n" for n in range(40)]
    new = "<html>\n<title>harbor edge relay node</title>\n<h1>harbor edge relay node 7</h1>\n<p>the edge upstream of harbor relay</p>\n</html>"
    assert R.shares(new)[0] == 0
    unlearnt = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % R.THIN)  # without a phrase it would teach as a negative
    rows = [(i, t, f"r{i % 7}") for i, t in enumerate([*pages, *own])] + [(unlearnt, new, "r0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, repository_name string")
    got = {r.doc_id: r.kinds for r in R.residue(df).collect()}
    assert set(got) == {*range(len(pages)), unlearnt} and got[unlearnt] == ["words"]
    assert R.without_residue(df).count() == len(own)


def test_long_error_line():
    text = "503 Service Unavailable, 502 Bad Gateway, 504 Gateway Timeout, 500 Internal Server Error, " * 3
    assert len(text) > 240 and R.shares(text)[3] == {"error"}
    assert R.shares("status 404, " + "17, " * 80)[3] == set()
