"""Encoding of a corpus with a public byte-level BPE vocabulary, as a streaming transducer with bounded lookahead.

Every text, however short, goes through the transducer window by window; no text is handed to the tokenizer whole.
Merges never cross the pieces into which the vocabulary's pattern splits a text, and a piece that ends before a blank is
final there: a window gives out its tokens up to the last such place and carries the rest. Where a window has none,
pieces are final as soon as a few characters after them are known. Within a piece that is longer than the window, tokens
are final once they end before the merge list's sufficient lookahead: the longest chain of merges in which each one of
higher rank may take the tail from the next. It is computed from the merge list (4,125 bytes for byte_bpe_50k). So the
state between windows is a window and a lookahead at most, whatever the length of a text or of a piece; a row's ids are
its result and are held as 32-bit numbers until the row is written.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split pattern of the byte_bpe vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters that are read at once.
WINDOW = 1 << 11
_NONE = np.empty(0, np.int32)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=vocabulary(path), special_tokens={})


def operands(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes this one."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        i = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 40), i))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


@lru_cache(maxsize=4)
def sufficient_lookahead(path: str) -> int:
    """Bytes after a token's end that may still change it, at most.

    A merge uv is undone only by a merge of higher rank that begins with a proper suffix of v, and that one in turn only
    by one of still higher rank; the longest such chain, in bytes, bounds how far an appended text reaches back."""
    ranks = vocabulary(path)
    reach: dict[bytes, int] = {}
    most = 0
    for token in sorted(ranks, key=ranks.get):
        if len(token) < 2:
            continue
        v = operands(token, ranks)[1]
        far = len(token) + max((reach.get(v[k:], 0) for k in range(len(v))), default=0)
        for k in range(1, len(token) + 1):
            if reach.get(token[:k], 0) < far:
                reach[token[:k]] = far
        most = max(most, far)
    return most


class StreamingEncoder:
    """feed() parts of one text; each call gives the ids that have become final, close() the rest."""

    #: The kinds of character of which a piece may hold any number.
    RUNS = tuple(regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"\s+", r"[^\s\p{L}\p{N}]+"))
    #: Up to the last blank that follows a character that is none: whatever comes, a piece ends there.
    SETTLED = re.compile(r"(?s:.*)\S(?=[ \n])")

    def __init__(self, path: str) -> None:
        self.path, self.enc, self.split = path, encoding(path), regex.compile(PATTERN)
        self.rest, self.inside, self.run = "", b"", None  # open characters; open bytes and kind of an overlong piece

    def feed(self, part: str, window: int = WINDOW) -> np.ndarray:
        text, out = self.rest + part, []
        if self.run is not None:
            size = self._length(text, False)
            if size is None:
                return self._commit(text)
            self.inside += text[:size].encode()
            out.append(self._emit(True))
            text = text[size:]
        if m := self.SETTLED.match(text):
            out.append(self._ids(text[: m.end()]))
            text = text[m.end() :]
        self.rest = text
        if len(text) > max(window, 16):
            out.append(self._without_blanks(window))
        return np.concatenate(out) if out else _NONE

    def _ids(self, text: str) -> np.ndarray:
        """Of a text that begins and ends with a piece."""
        return self.enc.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def _without_blanks(self, window: int) -> np.ndarray:
        """What is final in a window without a settled place: whole pieces, or the head of an overlong one."""
        text, start, out = self.rest, 0, []
        for m in self.split.finditer(text):
            if m.end() + 3 >= len(text):  # a contraction or the end of blanks shows within three characters
                break
            if not text[m.end() - 1].isspace():  # where blanks end depends on what follows, so none ends the part
                start = m.end()
        out.append(self._ids(text[:start]))
        text = text[start:]
        while (m := self.split.match(text)) and m.end() + 3 < len(text):
            out.append(np.array(self.enc._encode_single_piece(m.group()), np.int32))
            text = text[m.end() :]
        self.rest = text
        if len(text) > max(window, 16):
            last = text[self.split.match(text).end() - 5]
            self.run = next(r for r in self.RUNS if r.match(last))
            out.append(self._commit(text))
        return np.concatenate(out)

    def _length(self, text: str, last: bool) -> int | None:
        """How much of the text still belongs to the overlong piece; None if that isn't known yet."""
        m = self.run.match(text)
        size = m.end() if m else 0
        if size == len(text):
            return size if last else None
        if size + 4 > len(text) and not last:
            return None
        return size - (self.run is self.RUNS[2])  # the last blank before a word isn't of the run

    def _commit(self, text: str) -> np.ndarray:
        keep = max(0, len(text) - 4)  # the last characters stay open
        self.inside += text[:keep].encode()
        self.rest = text[keep:]
        return self._emit(False)

    def _emit(self, whole: bool) -> np.ndarray:
        keep, done, out = len(self.inside) - (0 if whole else sufficient_lookahead(self.path)), 0, []
        if whole:
            self.run = None
        elif keep <= 0:
            return _NONE
        for i in self.enc._encode_single_piece(self.inside):
            size = len(self.enc.decode_single_token_bytes(i))
            if done + size > keep:
                break
            done += size
            out.append(i)
        self.inside = self.inside[done:]
        return np.array(out, np.int32)

    def close(self) -> np.ndarray:
        out = []
        if self.run is not None:
            size = self._length(self.rest, True)
            self.inside += self.rest[:size].encode()
            self.rest = self.rest[size:]
            out.append(self._emit(True))
        out.append(self._ids(self.rest))
        self.rest = ""
        return np.concatenate(out)


class StreamingDecoder:
    """Ids to text: a byte-to-text state machine that holds back only an unfinished character."""

    def __init__(self, path: str) -> None:
        self.enc, self.state = encoding(path), codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.state.decode(self.enc.decode_bytes(ids))

    def close(self) -> str:
        return self.state.decode(b"", True)


def encode(text: str | None, path: str, window: int = WINDOW) -> np.ndarray:
    """Ids of a text as it stands; an empty and a null text give none."""
    if not text:
        return _NONE
    s = StreamingEncoder(path)
    return np.concatenate([*(s.feed(text[k : k + window], window) for k in range(0, len(text), window)), s.close()])


def decode(ids, path: str, window: int = WINDOW) -> str:
    s = StreamingDecoder(path)
    return "".join(s.feed(ids[k : k + window]) for k in range(0, len(ids), window)) + s.close()


def vocabulary_path(spark, name: str = VOCABULARY) -> str:
    """strataloom.tokenizers names the folder of the vocabularies on every machine."""
    return os.path.join(spark.conf.get("strataloom.tokenizers", FOLDER), name)


def token_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row; no shuffle, one pass. Null and empty texts give an empty list.

    Strings of special tokens inside a text are ordinary text. Rows with repeated ids are encoded each."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            parts = [encode(t, path) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(p) for p in parts)], dtype=np.int32)
            flat = np.concatenate(parts) if parts else _NONE
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], names=[id_col, "ids"])

    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_ids, same): the number of ids and whether decoding them gives the text back, byte for byte."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = [encode(t, path) for t in texts]
            same = [decode(i.tolist(), path) == (t or "") for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(same)], names=[id_col, "n_ids", "same"])

    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_ids bigint, same boolean")
