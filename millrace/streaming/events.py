"""Event-time streaming (an extension): the same functions serve batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, size: str, keys: list[str], value: str, late: str = "10 minutes") -> DataFrame:
    """(window_start, keys, n, total) over fixed windows; late rows beyond the watermark drop
    out of a stream, never of a batch."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sliding(events: DataFrame, time: str, size: str, step: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, size, step), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """(session_start, session_end, keys, n): a session ends ``gap`` after its last event."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n")
