"""Streams that ran to their end, against the same rows as a table."""

import hashlib

from pyspark.sql import functions as F

from strataloom.plans import export_queries


def test_a_stream_s_rows_are_files_and_not_the_driver_s(spark, tmp_path):
    said = ["a", "b", "a", None, "c", "b"]
    rows = [(i, t, f"2025-0{i + 1}-01 00:00:00") for i, t in enumerate(said)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at string").select("doc_id", "text", F.col("at").cast("timestamp_ntz").alias("ingested_at"))
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = export_queries.QUERIES["stream_dedup"](spark, str(tmp_path))
    sha = {hashlib.sha256(t.encode()).hexdigest() for t in "abc"}
    assert sorted((r.sha256, r.document_id) for r in got.collect()) == sorted((x, "doc_" + x[:10]) for x in sha)
    assert got.inputFiles() and all("/out/" in f for f in got.inputFiles())


def test_windows_of_a_stream_are_whole_and_files(spark, tmp_path):
    rows = [("2025-01-01 10:05:00", "x", 1.0), ("2025-01-01 10:50:00", "x", 2.0), ("2025-01-01 12:00:00", "x", 4.0), ("2025-01-01 10:00:00", "y", 8.0)]
    events = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(f"{tmp_path}/full/events.parquet")
    got = export_queries.stream_windows(spark, f"{tmp_path}/full")
    assert got.inputFiles() and sorted(map(tuple, got.collect())) == [("x", 3, 2, 7.0), ("y", 1, 1, 8.0)]
    events.where("false").write.parquet(f"{tmp_path}/empty/events.parquet")
    assert export_queries.stream_windows(spark, f"{tmp_path}/empty").collect() == []
