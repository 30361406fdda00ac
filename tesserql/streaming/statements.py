"""Statement statistics over a log of events, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_entry(log: DataFrame) -> DataFrame:
    """Per user and kind of statement: rows, sum and extremes of their values."""
    return log.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("largest"))


def windows(log: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """The same per window; on a stream, windows close when the watermark passes them."""
    rows = log.withWatermark("ts", late) if log.isStreaming else log
    out = rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
