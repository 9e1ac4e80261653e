"""Pieces of pages against the rules that they must keep."""

import random
import unicodedata

from strataloom.llm import split as S


def rules(text, size=S.SIZE, overlap=S.OVERLAP):
    cuts = S.pieces(text, size, overlap)
    if not text:
        assert cuts == []
        return cuts
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(0 < z - a <= size for a, z in cuts)
    for (a, z), (b, y) in zip(cuts, cuts[1:]):
        assert a < b <= z < y and z - b <= overlap
    return cuts


def test_random_texts():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["word ", "x", "\n", "\n\n", ". ", "。", "é", "  ", "\r\n", "\U0001f468‍\U0001f469"]) for _ in range(rng.randint(0, 900)))
        rules(text, 100, 20)
        rules(text, 64, 0)


def test_brute_force_cut():
    rng = random.Random(4)
    text = "".join(rng.choice(["ab ", "c", ". ", "\n", ", "]) for _ in range(3000))
    s = S.strengths(text)
    for a, z in rules(text, 90, 20)[:-1]:
        window = range(a + 45, a + 91)
        best = max(s[i] for i in window)
        assert z == max(i for i in window if s[i] == best)


def test_natural_boundaries_and_marks():
    text = "First sentence here. " * 60
    assert all(text[:z].rstrip().endswith(".") for _, z in rules(text))
    text = "é" * 900
    assert all(not unicodedata.combining(text[z]) for _, z in rules(text)[:-1])
    assert rules("x" * 800) == [(0, 800)] and len(rules("x" * 801)) == 2


def test_long_text_in_blocks():
    text = ("A clause, then more. " * 9 + "\n\n") * 2000
    assert len(rules(text)) > 500


def test_table(spark):
    rows = [("d", 1, None, 5), ("d", 2, "", 5), ("d", 3, " " * 900, 5), ("d", 4, "a b. " * 200, 5), ("d", 4, "a b. " * 200, 5), (None, None, "y" * 2000, None)]
    df = spark.createDataFrame(rows, "document_id string, page_number int, text string, piece_index int")
    got = S.oversized(df, ["document_id", "page_number"]).collect()
    assert sorted((r[0] or "", r[1] or 0) for r in got) == [("", 0), ("d", 3), ("d", 4)]
    assert S.split_pages(df.limit(0), ["document_id"]).count() == 0
