"""Windowed means of an event stream: what the batch queries do by group, incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocline.functions.metrics import exact_mean


def tumbling_means(events: DataFrame, *, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, mean) of (ts, event_type, value); events later than the watermark are left out."""
    # a watermark needs a timestamp with a time zone: the session's
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    grouped = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("value").alias("n"), exact_mean(F.col("value")).alias("mean"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "mean")
