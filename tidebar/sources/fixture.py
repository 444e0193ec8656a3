"""A synthetic series of five-minute bars with a failed breakout, made from row numbers alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bars of a day, days of the rise, the failure and the fall, bars of the relief, and the open time of the first bar (2026-08-20 UTC).
DAY, RISE, FAILURE, FALL, RELIEF, START = 288, 8, 2, 3, 24, 1787184000


def breakout_bars(spark: SparkSession, symbol: str = "AVAXUSDT") -> DataFrame:
    """symbol, t, o, h, l, c, v: a grind to 8.06, wicks above 8.12 that fail, a fall to 7.30 and a bounce."""
    a, b, c = RISE * DAY, (RISE + FAILURE) * DAY, (RISE + FAILURE + FALL) * DAY
    i = F.col("id")
    n = F.when(i < a, i).when(i < b, i - a).when(i < c, i - b).otherwise(i - c).cast("double")
    low = 7.95 - (FALL * DAY - 1) * 0.00075
    price = F.when(i < a, F.least(F.lit(8.06), 7.2 + (n + 1) * 0.00038)).when(i < b, 8.02 - n * 0.00015).when(i < c, F.greatest(F.lit(7.28), 7.95 - n * 0.00075)).otherwise(max(7.28, low) + n * 0.012)
    rows = spark.range(c + RELIEF).select("id", price.alias("c")).withColumn("o", F.col("c") * F.when(i % 2 == 0, 1.0002).otherwise(0.9998))
    failing = (i >= a) & (i < b)
    high = F.when(failing, F.least(F.lit(8.22), 8.12 + ((i - a) % 7) * 0.012)).otherwise(F.greatest("o", "c") + 0.012)
    bottom = F.when(failing, F.col("c") - 0.03).otherwise(F.least("o", "c") - 0.012)
    return rows.select(F.lit(symbol).alias("symbol"), (START + 300 * i).alias("t"), "o", high.alias("h"), bottom.alias("l"), "c", (1000 + i).cast("double").alias("v"))
