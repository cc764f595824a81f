"""An extension of ours: usage events as a stream, in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """events (ts, event_type, value), streaming or not: events and their sum by window and type."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    out = source.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")
