"""Streaming encoding against the library's own encoding of the whole text."""

import random

import pytest

from strataloom.llm import tokenize as T

PATH = f"{T.FOLDER}/{T.VOCABULARY}"
TEXTS = ["", " ", "a", "it's we're they'll 'sabc  x\n\n  y", "<|endoftext|> is text", "你好世界 " * 40, "é\U0001f468‍\U0001f469‍\U0001f467" * 30, "   \t\r\n   " * 30, "x" * 500 + " " * 300 + "1234567890" * 40 + "!?-" * 90]


def streamed(text, window):
    s = T.StreamingEncoder(PATH)
    ids = [i for k in range(0, len(text), window) for i in s.feed(text[k : k + window], window)]
    return ids + list(s.close())


@pytest.mark.parametrize("window", [7, 64, 1000])
@pytest.mark.parametrize("text", TEXTS)
def test_windows_do_not_matter(text, window):
    assert streamed(text, window) == T.encoding(PATH).encode_ordinary(text)


def test_random_texts_and_round_trip():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["the ", "ing", "'", "s", " ", "  ", "\n", "é", "你", "9", "_", "Ab", "\U0001f600"]) for _ in range(rng.randint(0, 300)))
        ids = streamed(text, rng.randint(1, 50))
        assert ids == T.encoding(PATH).encode_ordinary(text)
        assert T.decode(ids, PATH, 3) == text


def test_overlong_pieces_need_the_lookahead():
    rng = random.Random(6)
    for alphabet in ("abcdefghij", "0123456789", " \n", "=-+"):
        text = "".join(rng.choice(alphabet) for _ in range(30_000))
        assert streamed(text, 6000) == T.encoding(PATH).encode_ordinary(text)


def test_null_and_empty_give_no_ids(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a b", "z"), (3, "a b", "z")], "doc_id long, text string, ids string")
    rows = sorted((r.doc_id, r.ids) for r in T.token_ids(df, PATH).collect())
    assert rows[:2] == [(1, []), (2, [])] and rows[2] == rows[3] and T.decode(rows[2][1], PATH) == "a b"
    assert T.token_ids(df.limit(0), PATH).collect() == []


@pytest.mark.parametrize("window", [5, 50, T.WINDOW])
def test_no_text_passes_beside_the_transducer(monkeypatch, window):
    fed = []
    feed = T.StreamingEncoder.feed
    monkeypatch.setattr(T.StreamingEncoder, "feed", lambda self, part, w=T.WINDOW: fed.append(len(part)) or feed(self, part, w))
    for text in ("a", "a few words of text.\n" * 9, "\u2003x\x1c y\x85z " * 40, "no_blank" * 900):
        fed.clear()
        assert list(T.encode(text, PATH, window)) == T.encoding(PATH).encode_ordinary(text)
        assert sum(fed) == len(text) and max(fed) <= window


def test_state_between_windows_is_bounded():
    s, window = T.StreamingEncoder(PATH), 256
    for k in range(60):
        s.feed(("word " if k < 20 else "=" if k < 40 else "ab") * 64, window)
        assert len(s.rest) <= 2 * window and len(s.inside) <= T.sufficient_lookahead(PATH) + 4 * window
