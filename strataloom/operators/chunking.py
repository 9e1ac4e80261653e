"""Pages of flowing text and overlapping chunks, as ordered folds inside one expression: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity, text

SIZE, OVERLAP, PAGE = 800, 150, 3000


def sentences(c: Column | str) -> Column:
    return F.filter(F.split(c, rf"(?<=[.?!;:\n]){text.BLANKS}+"), lambda s: s != "")


def chunk_texts(c: Column | str, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Sentences packed to ``size``; a chunk repeats the last sentences of the one before while they stay under
    ``overlap``. Lengths leave the joining blanks out, so a chunk may be a little longer."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def carried(open_: Column) -> Column:
        """The longest run of last sentences under the overlap, and its length."""
        zero = F.struct(F.array().cast("array<string>").alias("keep"), F.lit(0).alias("n"), F.lit(False).alias("full"))
        step = lambda a, s: F.when(a["full"] | (a["n"] + F.length(s) >= overlap), F.struct(a["keep"].alias("keep"), a["n"].alias("n"), F.lit(True).alias("full"))).otherwise(
            F.struct(F.concat(F.array(s), a["keep"]).alias("keep"), (a["n"] + F.length(s)).alias("n"), F.lit(False).alias("full"))
        )
        return F.aggregate(F.reverse(open_), zero, step)

    def merge(a: Column, s: Column) -> Column:
        tail = carried(a["open"])
        close = F.struct(
            F.concat(a["done"], F.array(text.strip(F.array_join(a["open"], " ")))).alias("done"),
            F.concat(tail["keep"], F.array(s)).alias("open"),
            (tail["n"] + F.length(s)).alias("n"),
        )
        more = F.struct(a["done"].alias("done"), F.concat(a["open"], F.array(s)).alias("open"), (a["n"] + F.length(s)).alias("n"))
        return F.when((a["n"] + F.length(s) > size) & (F.size(a["open"]) > 0), close).otherwise(more)

    done = F.aggregate(sentences(c), start, merge, lambda a: F.concat(a["done"], F.array(text.strip(F.array_join(a["open"], " ")))))
    return F.filter(done, lambda x: x != "")


def chunks(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(document_id, document_name, page_number, chunk_id, chunk_index, text, char_count, word_count).

    A page that fits is one chunk as it stands, blank ones are none. chunk_index counts through a document in the order of
    pages. It comes from a table of the pages' numbers of chunks, without their texts: only that is gathered by document,
    and a page's row then gets it by (document, page), so a document with a third of all pages is no hot key. Where
    chunk_index isn't asked for nothing is shuffled. Pages with equal keys count in the order of their texts' digests."""
    from pyspark.sql import Window

    t = F.col("text")
    blank = t.isNull() | (text.strip(t) == "")
    parts = F.when(F.length(t) <= size, F.array(text.strip(t))).otherwise(chunk_texts(t, size, overlap))
    base = pages.where(~blank).select("document_id", "document_name", "page_number", F.xxhash64("text").alias("digest"), parts.alias("parts"))
    key = ["document_id", "page_number", "digest"]
    counts = base.select(*key, F.size("parts").alias("n")).groupBy(*key).agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("document_id").orderBy("page_number", "digest").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select(*[F.col(k).alias(f"__{k}") for k in key], F.coalesce(before, F.lit(0)).alias("before"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    cut = base.join(first, same[0] & same[1] & same[2], "left").select("document_id", "document_name", "page_number", "before", F.posexplode("parts").alias("sub", "text"))
    return cut.select(
        "document_id",
        "document_name",
        "page_number",
        identity.chunk_id(F.col("document_id"), F.col("page_number"), F.col("sub")).alias("chunk_id"),
        (F.col("before") + F.col("sub")).cast("int").alias("chunk_index"),
        "text",
        F.length("text").alias("char_count"),
        text.word_count("text").cast("int").alias("word_count"),
    )


def page_texts(c: Column | str, size: int = PAGE) -> Column:
    """Whole lines packed to pages, trimmed; blank pages take no number."""
    c = F.col(c) if isinstance(c, str) else c
    lines = F.regexp_extract_all(c, F.lit(r"([^\n]*\n|[^\n]+$)"), F.lit(1))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    merge = lambda a, x: F.when(
        (F.length(a["open"]) + F.length(x) > size) & (F.length(a["open"]) > 0), F.struct(F.concat(a["done"], F.array(text.strip(a["open"]))).alias("done"), x.alias("open"))
    ).otherwise(F.struct(a["done"].alias("done"), F.concat(a["open"], x).alias("open")))
    return F.filter(F.aggregate(lines, start, merge, lambda a: F.concat(a["done"], F.array(text.strip(a["open"])))), lambda p: p != "")


def pages(docs: DataFrame, size: int = PAGE) -> DataFrame:
    """(document_id, document_name, page_number, text, char_count, word_count) of flowing texts."""
    cut = docs.select("document_id", "document_name", F.posexplode(page_texts("text", size)).alias("i", "text"))
    return cut.select("document_id", "document_name", (F.col("i") + 1).alias("page_number"), "text", F.length("text").alias("char_count"), text.word_count("text").cast("int").alias("word_count"))


def totals(pages_: DataFrame) -> DataFrame:
    """(document_id, n_pages, total_chars, total_words)"""
    return pages_.groupBy("document_id").agg(F.count("*").alias("n_pages"), F.sum(F.length("text")).alias("total_chars"), F.sum(text.word_count("text")).alias("total_words"))
