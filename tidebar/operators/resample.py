"""Parent bars of complete buckets only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resample(bars: DataFrame, minutes: int, parent: int) -> DataFrame:
    """Buckets are aligned to the epoch; one with fewer rows than parent / minutes is dropped."""
    width = 60 * parent
    bucket = (F.floor(F.col("t") / width) * width).cast("long").alias("t")
    grouped = bars.groupBy("symbol", bucket.alias("p")).agg(
        F.min_by("o", "t").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "t").alias("c"), F.sum("v").alias("v"), F.count("*").alias("n")
    )
    return grouped.where(F.col("n") >= parent // minutes).select("symbol", F.col("p").alias("t"), "o", "h", "l", "c", "v")


def visible(bars: DataFrame, minutes: int, as_of: int) -> DataFrame:
    """What is known at as_of; written so that the filter reaches a scan on t."""
    return bars.where(F.col("t") <= as_of - 60 * minutes)
