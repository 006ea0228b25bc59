"""Event-time windows over streams, and the same plan over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n, total) per tumbling window; on a stream, state is dropped once the watermark has passed."""
    if dict(events.dtypes)[ts] != "timestamp":
        events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    w = events.groupBy(F.window(ts, width).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "key", "n", "total")
