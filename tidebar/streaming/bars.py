"""Closed bars from a stream of events: a bar is emitted once the watermark has passed its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closed_bars(events: DataFrame, minutes: int, lateness: str = "10 minutes") -> DataFrame:
    """For append mode; rows later than the watermark are dropped."""
    order = F.struct("ts", "event_id")
    bars = events.withWatermark("ts", lateness).groupBy("event_type", F.window("ts", f"{minutes} minutes"))
    bars = bars.agg(F.min_by("value", order).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", order).alias("c"), F.count("*").cast("double").alias("v"))
    return bars.select(F.col("event_type").alias("symbol"), F.unix_timestamp("window.start").alias("t"), "o", "h", "l", "c", "v")


def sliding_bars(events: DataFrame, minutes: int, slide: int, lateness: str = "10 minutes") -> DataFrame:
    """Bars of ``minutes`` that begin every ``slide`` minutes; of a stream or a table."""
    order = F.struct("ts", "event_id")
    bars = _watermarked(events, lateness).groupBy("event_type", F.window("ts", f"{minutes} minutes", f"{slide} minutes"))
    bars = bars.agg(F.min_by("value", order).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", order).alias("c"), F.count("*").cast("double").alias("v"))
    return bars.select(F.col("event_type").alias("symbol"), F.unix_timestamp("window.start").alias("t"), "o", "h", "l", "c", "v")


def sessions(events: DataFrame, gap: int, lateness: str = "10 minutes") -> DataFrame:
    """symbol, t, ends, events: runs of events with at most ``gap`` minutes between neighbours; a session ends that long after its last event."""
    runs = _watermarked(events, lateness).groupBy("event_type", F.session_window("ts", f"{gap} minutes").alias("s")).agg(F.count("*").alias("events"))
    return runs.select(F.col("event_type").alias("symbol"), F.unix_timestamp("s.start").alias("t"), F.unix_timestamp("s.end").alias("ends"), "events")


def _watermarked(events: DataFrame, lateness: str) -> DataFrame:
    return events.withWatermark("ts", lateness) if events.isStreaming else events
