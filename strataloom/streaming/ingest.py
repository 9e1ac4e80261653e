"""Streams of documents and events: ingestion without repeats, windowed counts with late data, graph upserts per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity


def document_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def without_repeats(stream: DataFrame, text_col: str = "text", time_col: str = "ingested_at", late: str = "90 days") -> DataFrame:
    """The first row of each content within the watermark; the state that is kept is bounded by it."""
    keyed = stream.where(F.col(text_col).isNotNull()).withColumns({"sha256": F.sha2(text_col, 256), "document_id": identity.document_id(text_col)})
    return keyed.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["sha256"])


def windowed_counts(stream: DataFrame, time_col: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and key; rows later than the watermark are left out."""
    ts = F.col(time_col).cast("timestamp")
    return stream.withColumn("__t", ts).withWatermark("__t", late).groupBy(F.window("__t", window).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(stream: DataFrame, time_col: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    ts = F.col(time_col).cast("timestamp")
    return stream.withColumn("__t", ts).withWatermark("__t", late).groupBy(F.session_window("__t", gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def ingest_batches(stream: DataFrame, handle, checkpoint: str, available_now: bool = True):
    """handle(batch, batch_id) for each micro-batch; batches that were done aren't repeated after a restart."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def collected(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """A finished run of a stream over what there is now, as Parquet tables under ``folder`` (shared, of this run alone).

    Executors write the rows, so the driver holds none of them. In append mode each batch adds its rows; in complete mode
    the last batch's result counts."""
    out, schema = f"{folder}/out", stream.schema
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", out).start()
    else:
        stream.sparkSession.createDataFrame([], schema).write.parquet(out)  # for a stream without rows
        q = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(out)
