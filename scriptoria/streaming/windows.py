"""Structured Streaming forms of the telemetry operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate(events: DataFrame, time: str, amount: str, size: str = "3 seconds", slide: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Sliding sums of an amount with a watermark."""
    w = events.withWatermark(time, late).groupBy(F.window(time, size, slide))
    return w.agg(F.sum(amount).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "total")


def stage_counts(events: DataFrame, time: str, stage: str, failed, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Jobs and failures per stage and tumbling window; late rows beyond the watermark go."""
    w = events.withWatermark(time, late).groupBy(F.window(time, size), stage)
    return w.agg(F.count("*").alias("n"), F.count_if(failed).alias("failed")).select(F.col("window.start").alias("start"), stage, "n", "failed")


def cooled_down(events: DataFrame, time: str, key: str, cooldown: str = "24 hours") -> DataFrame:
    """The first event of a key within its cooldown."""
    return events.withWatermark(time, cooldown).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, time: str, key: str, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Activity sessions per key that end after a gap."""
    s = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key)
    return s.agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def append_new(batch: DataFrame, known_path: str) -> None:
    """foreachBatch body: appends rows whose file_hash isn't below known_path yet."""
    spark = batch.sparkSession
    try:
        known = spark.read.parquet(known_path).select("file_hash")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = spark.createDataFrame([], "file_hash string")
    batch.dropDuplicates(["file_hash"]).join(known, "file_hash", "left_anti").write.mode("append").parquet(known_path)
