"""Folds of the event stream: the last write of each key, and counts by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.streaming.base import events_stream, run_to_end


def last_writes(spark: SparkSession, folder: str) -> DataFrame:
    """State after the log; order of arrival does not matter, as the entry with the highest number wins."""
    state = events_stream(spark, folder).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("value"), F.max("event_id").alias("seq"))
    return run_to_end(state, "stream-last", "complete")


def windowed_counts(spark: SparkSession, folder: str, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Counts of windows that the watermark has closed; rows later than it are dropped."""
    rows = events_stream(spark, folder).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counts = rows.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return run_to_end(counts.select(F.col("w.start").cast("timestamp_ntz").alias("opened"), "event_type", "n"), "stream-windows")
