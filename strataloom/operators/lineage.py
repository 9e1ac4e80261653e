"""Cutting of long plans by tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_opened: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a single machine has one of its own, as tests do;
    a cluster's executors share no such folder, so there it is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "strataloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def application_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, which goes when the driver ends; sweep() empties it before."""
    base = f"{shared_folder(spark)}/strataloom-{spark.sparkContext.applicationId}"
    if base not in _opened:
        _opened[base] = spark
        atexit.register(_leave, base)
    return base


def _leave(base: str) -> None:
    try:
        drop_table(_opened.pop(base), base)
    except Exception:  # the JVM is gone already
        pass


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that cut() wrote and that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def sweep(spark: SparkSession) -> None:
    """Delete all tables of this application's cuts: for the end of a query whose result has been written."""
    drop_table(spark, application_folder(spark))


class Cut:
    """A sequence of tables of which only the newest is kept: each round of an iteration writes one.

    A written table costs one computation (checkpoint() computes twice), is columnar and compressed, and outlives any
    executor. ``keep`` is the number of older tables that stay readable.
    """

    def __init__(self, spark: SparkSession, name: str, keep: int = 1) -> None:
        self.spark, self.keep = spark, keep
        self.base = f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}"
        df.write.parquet(path)
        self.paths.append(path)
        if len(self.paths) > self.keep + 1 and (old := self.paths[-self.keep - 2]):
            drop_table(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read again."""
    return Cut(df.sparkSession, name)(df)


def _stamp(spark: SparkSession, path: str) -> str:
    """When a file or folder was last changed and how long it is, so that a table made of it is known to be stale."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = fs.getContentSummary(hadoop)
    return f"{path}:{fs.getFileStatus(hadoop).getModificationTime()}:{whole.getLength()}:{whole.getFileCount()}"


def kept(spark: SparkSession, name: str, sources: list[str], make) -> DataFrame:
    """make()'s table, written once per application and state of its sources, and read by whoever asks again."""
    stamp = hashlib.sha256("|".join([name, *(_stamp(spark, p) for p in sources)]).encode()).hexdigest()[:24]
    path = f"{application_folder(spark)}/kept-{name}-{stamp}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
