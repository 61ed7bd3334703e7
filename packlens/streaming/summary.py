"""Incremental counters over arriving files (an extension: event-time windows with a watermark)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(files: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """files (batch or stream): time, size. Files and bytes of each window; rows later than `late` are dropped in a
    stream, which bounds the state."""
    return files.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).select(F.col("window.start").alias("start"), "files", "bytes")
