"""Joins whose probe side may have a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks over which the rows of any one key are spread.
WAYS = 16


def salted_join(big: DataFrame, small: DataFrame, on: list[str], row: list[str], how: str = "inner", ways: int = WAYS) -> DataFrame:
    """big joined to small, which has one row a key at most; a key's rows of big go to ``ways`` tasks by a hash of ``row``.

    small's row is copied to each of them, so this is for a small side that is much smaller than the other. Null keys
    match nothing, as in any join."""
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return big.withColumn("__salt", F.pmod(F.xxhash64(*row), F.lit(ways)).cast("int")).join(copies, [*on, "__salt"], how).drop("__salt")


#: A key is hot if it has more than one in HOT_SHARE of all rows, and more than HOT_ROWS: fewer than HOT_SHARE keys can.
HOT_SHARE, HOT_ROWS = 1000, 1_000_000


def hot_limit(rows: int) -> int:
    return max(HOT_ROWS, rows // HOT_SHARE)


def counted_join(big: DataFrame, small: DataFrame, on: str | list[str], limit: int, hottest: int) -> DataFrame:
    """big joined to small (one row a key, with n, the number of big's rows that it has).

    Keys of more than ``limit`` rows, of which there are fewer than HOT_SHARE (see hot_limit), are broadcast, so their rows
    of big stay where they are; the rest is shuffled by key. Where the hottest key has no more, there is only the latter."""
    if hottest <= limit:
        return big.join(small.drop("n"), on)
    hot = F.broadcast(small.where(F.col("n") > limit).drop("n"))
    cold = small.where(F.col("n") <= limit).drop("n")
    return big.join(hot, on).unionByName(big.join(F.broadcast(small.where(F.col("n") > limit).select(on)), on, "left_anti").join(cold, on))


def join_counted(big: DataFrame, small: DataFrame, on: str | list[str], rows: int | None = None) -> DataFrame:
    """counted_join() where small is a written table: its hottest key, and the rows of big that it has, are read from it."""
    if rows is not None and rows <= hot_limit(rows):
        return big.join(small.drop("n"), on)
    r = small.agg(F.sum("n").alias("rows"), F.max("n").alias("hottest")).first()
    return counted_join(big, small, on, hot_limit(rows if rows is not None else r.rows or 0), r.hottest or 0)
