"""As-of attachment: the latest right row known at each left row's time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_attach(left: DataFrame, right: DataFrame, left_time: str, right_time: str, columns: list[str], by: str = "symbol") -> DataFrame:
    """Union and last value by (by, time): one shuffle and one sort, no inequality join. Right rows of the same time count as known."""
    l = left.select(F.col(by).alias("_by"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("_got"))  # noqa: E741
    r = right.select(F.col(by).alias("_by"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.struct(*columns).alias("_got"))
    w = Window.partitionBy("_by").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_got", F.last("_got", ignorenulls=True).over(w))
    return both.where("_side = 1").select("_row.*", *[F.col(f"_got.{c}").alias(c) for c in columns])
