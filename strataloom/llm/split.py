"""Splitting of oversized texts at natural boundaries, with overlap.

Every position of a text has a boundary strength. A sparse table over the strengths answers the strongest position of
any permissible window in constant time; among equals the rightmost wins, so pieces come out long. Each next piece
begins up to ``overlap`` characters before the cut, at a natural boundary where there is one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 800, 150
BLOCK = 1 << 16
#: Strengths: between two paragraphs, lines, sentences, clauses, words, other characters; never inside a character.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, ANY, NEVER = 6, 5, 4, 3, 2, 1, 0
_BLANK = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288], np.uint32)
_STOP = np.array([ord(c) for c in ".!?…。！？؟।"], np.uint32)
_WIDE_STOP = np.array([ord(c) for c in "。！？"], np.uint32)
_PAUSE = np.array([ord(c) for c in ",;:、，；：،"], np.uint32)
_WIDE_PAUSE = np.array([ord(c) for c in "、，；："], np.uint32)
_CLOSE = np.array([ord(c) for c in "\"')]}»”’"], np.uint32)
#: Ranges of characters that attach to the one before: combining marks, joiners, variation selectors, skin tones, tags.
_ATTACHED = ((0x300, 0x36F), (0x483, 0x489), (0x591, 0x5BD), (0x610, 0x61A), (0x64B, 0x65F), (0x900, 0x903), (0x93A, 0x93C), (0x93E, 0x94F), (0xE31, 0xE31), (0xE34, 0xE3A), (0xE47, 0xE4E), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x200C, 0x200D), (0x20D0, 0x20FF), (0x3099, 0x309A), (0xFE00, 0xFE0F), (0xFE20, 0xFE2F), (0x1F3FB, 0x1F3FF), (0xE0020, 0xE01EF))


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each of the characters 0..n of a text; 0 and n are no inner cuts but count as PARAGRAPH."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(c)
    s = np.full(n + 1, ANY, np.int64)
    if n > 1:
        before, after = c[:-1], c[1:]
        blank = np.isin(c, _BLANK)
        gap = blank[:-1] & ~blank[1:]  # after the blanks, before the next word
        inner = s[1:n]
        inner[blank[:-1] | blank[1:]] = WORD
        # the last character before the run of blanks that ends at each position
        last = np.maximum.accumulate(np.where(blank, -1, np.arange(n)))[:-1]
        word_end = c[np.maximum(last, 0)]
        inner_close = np.isin(word_end, _CLOSE) & (last > 0)
        word_end = np.where(inner_close, c[np.maximum(last - 1, 0)], word_end)
        inner[gap & np.isin(word_end, _PAUSE)] = CLAUSE
        inner[np.isin(before, _WIDE_PAUSE)] = CLAUSE
        inner[gap & np.isin(word_end, _STOP)] = SENTENCE
        inner[np.isin(before, _WIDE_STOP) & ~np.isin(after, _WIDE_STOP)] = SENTENCE
        line = (c == 10) | ((c == 13) & (np.append(c[1:], 0) != 10)) | (c == 8232) | (c == 8233)
        ends = np.cumsum(line)
        at_last = np.where(last >= 0, ends[np.maximum(last, 0)], 0)
        breaks = ends[:-1] - at_last
        inner[gap & (breaks == 1)] = LINE
        inner[gap & (breaks > 1)] = PARAGRAPH
        attached = np.zeros(n - 1, bool)
        for lo, hi in _ATTACHED:
            attached |= (after >= lo) & (after <= hi)
        attached |= (before == 0x200D) | ((before == 13) & (after == 10)) | ((before >= 0x1F1E6) & (before <= 0x1F1FF) & (after >= 0x1F1E6) & (after <= 0x1F1FF))
        inner[attached] = NEVER
    s[0] = s[n] = PARAGRAPH
    return s


class RangeMaximum:
    """Sparse table over values; windows up to ``widest`` long."""

    def __init__(self, values: np.ndarray, widest: int) -> None:
        level = values
        self.levels = [level]
        while (2 << (len(self.levels) - 1)) <= min(widest, len(values)):
            half = 1 << (len(self.levels) - 1)
            level = np.maximum(level[:-half], level[half:])
            self.levels.append(level)

    def top(self, lo: int, hi: int) -> int:
        """The largest value at lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        level = self.levels[k]
        return max(int(level[lo]), int(level[hi + 1 - (1 << k)]))


def pieces(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece, in code points; none for a null or empty text, one for a text that fits.

    A piece is at least half of ``size`` long, except the last, and at most ``size``; it begins at most ``overlap``
    before the end of the one before it. The pieces cover the text without a gap."""
    if not text:
        return []
    n = len(text)
    least = max(size // 2, min(size, overlap + 1))
    out: list[tuple[int, int]] = []
    start, base, stop = 0, 0, -1
    right = left = None
    while n - start > size:
        if start + size > stop or right is None:  # tables cover a block at a time, so memory doesn't follow the length
            base, stop = max(0, start - 64), min(n, start + BLOCK + size)
            s = strengths(text[base:stop])
            if stop < n:
                stop -= 64  # marks after the block's end may still matter
            if base:
                s[0] = ANY
            at = np.arange(len(s), dtype=np.int64)
            right = RangeMaximum(s * len(s) + at, size)
            left = RangeMaximum(s * len(s) + (len(s) - 1 - at), size)
            width = len(s)
        cut = right.top(start + least - base, start + size - base) % width + base
        out.append((start, cut))
        start = cut
        if overlap:  # the strongest boundary that leaves at least half of the overlap, else all of it
            best = left.top(cut - overlap - base, cut - overlap // 2 - base)
            start = cut - overlap if best // width < WORD else base + width - 1 - best % width
    out.append((start, n))
    return out


def split_pages(pages: DataFrame, keys: list[str], text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """keys, piece_index, piece_count, start, end, text of every piece; rows are split where they stand, without a shuffle.

    Null and empty texts give no piece, blank ones that fit one piece. Repeated rows give repeated pieces; drop
    duplicates before if each page should count once. Columns other than keys and text are ignored."""
    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for b in batches:
            texts = b.column(len(keys)).to_pylist()
            rows, index, count, begin, end, piece = [], [], [], [], [], []
            for i, t in enumerate(texts):
                cuts = pieces(t, size, overlap)
                for j, (a, z) in enumerate(cuts):
                    rows.append(i), index.append(j), count.append(len(cuts)), begin.append(a), end.append(z), piece.append(t[a:z])
            take = pa.array(rows, pa.int32())
            i32 = pa.int32()
            yield pa.RecordBatch.from_arrays(
                [*(c.take(take) for c in b.columns[: len(keys)]), pa.array(index, i32), pa.array(count, i32), pa.array(begin, i32), pa.array(end, i32), pa.array(piece, pa.string())],
                names=[*keys, "piece_index", "piece_count", "start", "end", "text"],
            )

    return pages.select(*keys, F.col(text_col)).mapInArrow(run, f"{kinds}, piece_index int, piece_count int, start int, end int, text string")


def oversized(pages: DataFrame, keys: list[str], text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """keys of each page that had to be cut, once."""
    cuts = split_pages(pages, keys, text_col, size, overlap)
    return cuts.where("piece_index = 1").select(*keys).distinct()
