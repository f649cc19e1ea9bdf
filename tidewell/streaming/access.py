"""The access log as a stream: windows with late rows, and sessions. The same operators take a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(access: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "90 days") -> DataFrame:
    """(access_type, start, n, avg_score) by window; a stream drops rows later than ``late``."""
    if access.isStreaming:
        access = access.withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    found = access.groupBy("access_type", window.alias("w")).agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"))
    return found.select("access_type", F.col("w.start").alias("start"), "n", "avg_score")


def sessions(access: DataFrame, gap: str = "30 minutes", late: str = "1 day", key: str = "doc_id") -> DataFrame:
    """(key, start, end, n): runs of accesses with less than ``gap`` between them."""
    if access.isStreaming:
        access = access.withWatermark("ts", late)
    found = access.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
