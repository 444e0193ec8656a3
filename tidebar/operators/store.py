"""Append-only tables: bars that never change, and journals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ImmutableConflict(ValueError):
    """A key is already stored with other values."""


def new_rows(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not stored, once each; the same row again is no change, other values under a stored key are an error."""
    values = [c for c in incoming.columns if c not in key]
    sign = F.struct(*values)
    seen = stored.select(*key, sign.alias("_old"), F.lit(True).alias("_there"))
    fresh = incoming.withColumn("_new", sign)
    clash = fresh.groupBy(*key).agg(F.min("_new").alias("_lo"), F.max("_new").alias("_hi")).join(seen, key, "left")
    if not clash.where("not (_lo <=> _hi) or (_there and not (_lo <=> _old))").isEmpty():
        raise ImmutableConflict(f"values differ under a key of {key}")
    return fresh.drop("_new").join(seen, key, "left_anti").dropDuplicates(key)


def append(path: str, incoming: DataFrame, key: list[str], partitions: tuple[str, ...] = ()) -> None:
    """Writes what is new under path; for a stream, call it in foreachBatch."""
    spark = incoming.sparkSession
    try:
        stored = spark.read.parquet(path)
    except Exception as e:  # only a path that is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = incoming.limit(0)
    new_rows(stored, incoming, key).write.mode("append").partitionBy(*partitions).parquet(path)


def sync_counts(stored: DataFrame, incoming: DataFrame, key: list[str], fixed: str) -> DataFrame:
    """wrote / kept / refused: new keys, keys with the same fixed value, and keys whose fixed value would move."""
    old = stored.select(*key, F.col(fixed).alias("_old"), F.lit(True).alias("_there"))
    j = incoming.join(old, key, "left")
    same = F.col(fixed).eqNullSafe(F.col("_old"))
    return j.agg(F.count(F.when(F.col("_there").isNull(), 1)).alias("wrote"), F.count(F.when(F.col("_there") & same, 1)).alias("kept"), F.count(F.when(F.col("_there") & ~same, 1)).alias("refused"))
