"""Windowed aggregation of event streams: beyond the dialect, which is batch only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", stamp: str = "ts") -> DataFrame:
    """Count and total value of events by tumbling window and type.

    Works on a stream (rows later than ``late`` behind the newest one are dropped, and a window is
    final once the watermark has passed it) and on a batch (every row counts). State is one row per
    open window and type.
    """
    at = F.col(stamp).cast("timestamp")
    timed = events.withColumn("_at", at).withWatermark("_at", late)
    found = timed.groupBy(F.window("_at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", "total")
