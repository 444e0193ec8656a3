"""Bars from ordered events.

A bar is keyed by (symbol, t): t is its open time in epoch seconds. A bar of ``minutes`` is
known from t + 60 * minutes on; every point-in-time operator filters on that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bars_from_events(spark: SparkSession, sf_dir: str, minutes: int = 240) -> DataFrame:
    """symbol, t, o, h, l, c, v: one partially aggregated shuffle on (symbol, t)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "event_id", "value")
    width = 60 * minutes
    # a time without a zone is read as UTC, whatever the session's zone
    zoneless = dict(events.dtypes)["ts"] == "timestamp_ntz"
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") if zoneless else F.unix_timestamp(F.col("ts").cast("timestamp"))
    t = (F.floor(seconds / width) * width).cast("long").alias("t")
    order = F.struct("ts", "event_id")
    return events.groupBy(F.col("event_type").alias("symbol"), t).agg(
        F.min_by("value", order).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", order).alias("c"), F.count("*").cast("double").alias("v")
    )


def bars_sql(minutes: int = 240) -> str:
    """The same bars in DuckDB."""
    w = 60 * minutes
    return f"""select event_type as symbol, floor(epoch(ts) / {w})::bigint * {w} as t, first(value order by ts, event_id) as o, max(value) as h,
        min(value) as l, last(value order by ts, event_id) as c, count(*)::double as v from events group by 1, 2"""
