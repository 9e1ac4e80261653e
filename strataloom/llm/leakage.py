"""Evaluation passages inside a corpus: which document holds which items.

A document leaks an item if it holds a window of 20 consecutive words of it. Such a window has 16 shingles of five
words and the document must hold all of them, so a set join with full containment needs a prefix of one shingle per
window: the one that is rarest in the corpus. Windows are joined by that shingle alone, at the position that it has in
the window, and a candidate is verified word by word over the window.

The items are a stated query set: they are indexed on the driver in blocks of bounded size and each block is sent to the
executors, where every document is met once, without any shuffle of texts. Only the counts of the items' own shingles
are gathered, over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS, SHINGLE = 20, 5
#: Words of items that are indexed at once; the size of what a broadcast holds follows from it (about 40 bytes a word).
BLOCK_WORDS = 1_000_000
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters or digits in lower case."""
    return _WORD.findall(text.lower()) if text else []


def _hashes(ids: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each n consecutive ids; 0 where one of them is 0."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    size = len(ids) - n + 1
    h, sound = np.zeros(size, np.uint64), np.ones(size, bool)
    for k in range(n):
        part = ids[k : k + size]
        h = (h ^ part.astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
        sound &= part != 0
    return np.where(sound, h | np.uint64(1), np.uint64(0))


class Items:
    """Words and shingles of a block of items. Word 0 is any word that no item has; items are parted by it."""

    def __init__(self, items: list[tuple[object, str | None]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.item_ids = [i for i, _ in items]
        ids, owner = [0], [0]
        for k, (_, text) in enumerate(items):
            for w in words(text):
                ids.append(self.vocabulary.setdefault(w, len(self.vocabulary) + 1))
                owner.append(k)
            ids.append(0)
            owner.append(k)
        self.ids, self.owner = np.array(ids, np.int32), np.array(owner, np.int32)
        self.hash = _hashes(self.ids)
        self.known = np.unique(self.hash[self.hash != 0])

    def place(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts as ids, a 0 after each text, and the text that each word is of."""
        get, parts, sizes = self.vocabulary.get, [], []
        for t in texts:
            w = words(t)
            parts += [get(x, 0) for x in w]
            parts.append(0)
            sizes.append(len(w) + 1)
        return np.array(parts, np.int32), np.repeat(np.arange(len(texts), dtype=np.int32), sizes)

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(shingle, occurrences) of the items' shingles in the texts."""
        h = _hashes(self.place(texts)[0])
        h = h[h != 0]
        at = np.searchsorted(self.known, h)
        h = h[(at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == h)] if len(self.known) else h[:0]
        return np.unique(h, return_counts=True)

    def index(self, counts: dict[int, int], n: int = WORDS) -> "Index":
        return Index(self, counts, n)


class Index:
    """Of each window its rarest shingle, and where in the window that stands."""

    def __init__(self, items: Items, counts: dict[int, int], n: int) -> None:
        self.items, self.n = items, n
        ids, span = items.ids, n - SHINGLE + 1
        starts = np.empty(0, np.int64)
        if len(ids) >= n:
            sound = np.lib.stride_tricks.sliding_window_view(ids != 0, n).all(axis=1)
            starts = np.flatnonzero(sound)
        if len(starts):
            # the same window in several places of one item counts once
            h = items.hash
            rank = np.array([counts.get(int(x), 0) for x in h], np.int64)
            view = np.lib.stride_tricks.sliding_window_view(rank, span)[starts]
            offset = view.argmin(axis=1)
            key = h[starts + offset]
        else:
            offset, key = np.empty(0, np.int64), np.empty(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key, self.start, self.offset = key[order], starts[order], offset[order]

    def find(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) of each leak, once."""
        ids, owner = self.items.place(texts)
        h = _hashes(ids)
        lo, hi = np.searchsorted(self.key, h, "left"), np.searchsorted(self.key, h, "right")
        hits = np.flatnonzero((hi > lo) & (h != 0))
        found = set()
        for a in range(0, len(hits), 1 << 14):  # candidates in bounded blocks
            at = hits[a : a + (1 << 14)]
            size = hi[at] - lo[at]
            w = np.repeat(lo[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            p = np.repeat(at, size) - self.offset[w]
            ok = (p >= 0) & (p + self.n <= len(ids))  # positional bound
            w, p = w[ok], p[ok]
            for b in range(0, len(w), 1 << 16):
                ww, pp = w[b : b + (1 << 16)], p[b : b + (1 << 16)]
                for k in range(self.n):
                    keep = ids[pp + k] == self.items.ids[self.start[ww] + k]
                    ww, pp = ww[keep], pp[keep]
                found.update(zip(owner[pp].tolist(), self.items.owner[self.start[ww]].tolist()))
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


def blocks(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK_WORDS) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of at most ``most`` words (or one item); one partition at a time comes to the driver."""
    block, size = [], 0
    for i, text in items.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        n = len(words(text))
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((i, text))
        size += n
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = WORDS) -> DataFrame:
    """(id, item) of each document that holds at least n consecutive words of an item, once.

    Null and empty texts hold nothing; items of fewer than n words leak nowhere. Repeated documents under different ids
    count each, rows that repeat an id count once."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}"
    found = None
    for block in blocks(items, item_col, text_col):
        known = spark.sparkContext.broadcast(Items(block))

        def count(batches, known=known):
            for b in batches:
                h, k = known.value.count(b.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k.astype(np.int64))], names=["shingle", "times"])

        counts = docs.select(text_col).mapInArrow(count, "shingle bigint, times bigint").groupBy("shingle").agg(F.sum("times").alias("times"))
        rare = {int(np.int64(s).view(np.uint64)): t for s, t in counts.toLocalIterator()}  # at most one row per shingle of the block
        index = spark.sparkContext.broadcast(known.value.index(rare, n))

        def find(batches, index=index):
            ids = index.value.items.item_ids
            for b in batches:
                doc, item = index.value.find(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array([ids[k] for k in item.tolist()], item_type)], names=[id_col, item_col])

        item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_kind]
        part = docs.select(id_col, text_col).mapInArrow(find, schema)
        found = part if found is None else found.unionByName(part)
    return found.distinct() if found is not None else spark.createDataFrame([], schema)


def leaked_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = WORDS) -> DataFrame:
    """(id, n_items, items) of each leaking document, the items in order."""
    pairs = leaks(docs, items, id_col, text_col, item_col, n)
    return pairs.groupBy(id_col).agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list(item_col)).alias("items"))


def leaked_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = WORDS) -> DataFrame:
    """(item, n_docs) of each item, 0 for those that leak nowhere."""
    pairs = leaks(docs, items, id_col, text_col, item_col, n).groupBy(item_col).agg(F.count("*").alias("n"))
    return items.select(item_col).distinct().join(pairs, item_col, "left").select(item_col, F.coalesce("n", F.lit(0)).alias("n_docs"))
