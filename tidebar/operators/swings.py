"""Swings of confirmed pivots, their ratio levels, measured moves, zone identifiers and plateaus, in DataFrame operations.

Every row carries the time from which it is known: the latest of its pivots'.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The ratios of retracements, extensions and measured moves.
RETRACEMENTS = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0)
EXTENSIONS = (1.272, 1.618, 2.0, 2.618)
MEASURED = (1.0, 1.272, 1.618)


def collapsed(pivots: DataFrame) -> DataFrame:
    """Of neighbouring pivots (symbol, t, known_t, price, kind) of one kind the most extreme, the first of equals; a run is one group."""
    by = Window.partitionBy("symbol").orderBy("t", "known_t", "kind")
    new = F.coalesce((F.lag("kind").over(by) != F.col("kind")).cast("int"), F.lit(1))
    runs = pivots.withColumn("new", new).withColumn("run", F.sum("new").over(by))
    extreme = F.when(F.col("kind") == "high", F.col("price")).otherwise(-F.col("price"))
    best = runs.groupBy("symbol", "run").agg(F.max_by(F.struct("t", "known_t", "price", "kind"), F.struct(extreme, -F.col("t"))).alias("p"))
    return best.select("symbol", "run", "p.*")


def anchors(pivots: DataFrame) -> DataFrame:
    """symbol, start_t, end_t, known_t, start_price, end_price, direction of every swing between collapsed neighbours of different price."""
    by = Window.partitionBy("symbol").orderBy("run")
    before = lambda c: F.lag(c).over(by)
    rows = collapsed(pivots).select("symbol", before("t").alias("start_t"), F.col("t").alias("end_t"), F.greatest(before("known_t"), "known_t").alias("known_t"), before("price").alias("start_price"), F.col("price").alias("end_price"))
    return rows.where("start_t is not null and start_price <> end_price").withColumn("direction", F.when(F.col("end_price") > F.col("start_price"), "up").otherwise("down"))


def _ratios(values) -> Column:
    return F.array(*map(F.lit, values))


def levels(pivots: DataFrame) -> DataFrame:
    """symbol, start_t, end_t, known_t, kind, ratio, price: retracements from the swing's end, extensions from its start."""
    span = F.col("end_price") - F.col("start_price")
    made = F.concat(F.transform(_ratios(RETRACEMENTS), lambda r: F.struct(F.lit("retracement").alias("kind"), r.alias("ratio"), (F.col("end_price") - span * r).alias("price"))), F.transform(_ratios(EXTENSIONS), lambda r: F.struct(F.lit("extension").alias("kind"), r.alias("ratio"), (F.col("start_price") + span * r).alias("price"))))
    return anchors(pivots).select("symbol", "start_t", "end_t", "known_t", F.inline(made))


def measured_moves(pivots: DataFrame) -> DataFrame:
    """symbol, end_t, correction_t, known_t, ratio, price: the swing once more from a correction strictly inside its range."""
    by = Window.partitionBy("symbol").orderBy("run")
    a, b = (lambda c: F.lag(c, 2).over(by)), (lambda c: F.lag(c).over(by))
    rows = collapsed(pivots).select("symbol", b("t").alias("end_t"), F.col("t").alias("correction_t"), F.greatest(a("known_t"), b("known_t"), "known_t").alias("known_t"), a("price").alias("pa"), b("price").alias("pb"), F.col("price").alias("pc"))
    rows = rows.where("pa is not null and pc > least(pa, pb) and pc < greatest(pa, pb)")
    return rows.select("symbol", "end_t", "correction_t", "known_t", "pa", "pb", "pc", F.explode(_ratios(MEASURED)).alias("ratio")).select("symbol", "end_t", "correction_t", "known_t", "ratio", (F.col("pc") + (F.col("pb") - F.col("pa")) * F.col("ratio")).alias("price"))


def zone_ids(zones: DataFrame) -> DataFrame:
    """zones (lower, upper, role) with zone_id: twelve digits of the SHA-1 of the edges at eight places and the role. Edges are rounded by their exact
    value, as printf does; format_string rounds up the shortest decimal of 1.5e-8, whose value lies below it."""

    @F.pandas_udf("string")
    def places(edges: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else f"{x:.8f}" for x in edges], dtype=object)

    edges_and_role = F.concat(places("lower"), F.lit(":"), places("upper"), F.lit(":"), "role")
    return zones.withColumn("zone_id", F.substring(F.sha1(edges_and_role), 1, 12))


def plateaus(bars: DataFrame, least: int = 3) -> DataFrame:
    """symbol, role, price, first_t, known_t, bars: runs of at least ``least`` equal highs (resistance) or lows (support), known at the least-th bar."""
    by = Window.partitionBy("symbol", "role").orderBy("t")
    rows = bars.select("symbol", "t", F.inline(F.array(F.struct(F.lit("resistance").alias("role"), F.col("h").alias("price")), F.struct(F.lit("support").alias("role"), F.col("l").alias("price")))))
    new = F.coalesce((F.lag("price").over(by) != F.col("price")).cast("int"), F.lit(1))
    rows = rows.withColumn("new", new).withColumn("run", F.sum("new").over(by)).withColumn("k", F.row_number().over(Window.partitionBy("symbol", "role", "run").orderBy("t")))
    runs = rows.groupBy("symbol", "role", "run").agg(F.first("price").alias("price"), F.min("t").alias("first_t"), F.max(F.when(F.col("k") == least, F.col("t"))).alias("known_t"), F.count("*").alias("bars"))
    return runs.where(F.col("bars") >= least).drop("run")


#: The least width of a band relative to its middle, and the timeframes (minutes) whose plateaus are zones.
LEAST_WIDTH, COARSE = 0.001, 240


def widened(zones: DataFrame) -> DataFrame:
    """zones with edges in order, at least LEAST_WIDTH of their middle and 1e-8 apart, also about a middle of 0."""
    low, high = F.least("lower", "upper"), F.greatest("lower", "upper")
    middle = (low + high) / 2
    width = F.greatest(F.abs(middle) * LEAST_WIDTH, F.lit(1e-8))
    thin = high - low < width
    return zones.withColumns({"lower": F.when(thin, middle - width / 2).otherwise(low), "upper": F.when(thin, middle + width / 2).otherwise(high)})


def plateau_specs(bars: DataFrame, minutes: int, least: int = 3) -> DataFrame:
    """symbol, lower, upper, role, strength, created_t, known_t, zone_id of plateaus of bars of four hours or more; equal ones are one, as the first of them."""
    runs = plateaus(bars, least).where(F.lit(minutes >= COARSE))
    specs = runs.select("symbol", F.col("price").alias("lower"), F.col("price").alias("upper"), "role", F.least(F.lit(1.0), 0.25 + 0.05 * F.col("bars")).alias("strength"), F.col("first_t").alias("created_t"), "known_t")
    specs = zone_ids(widened(specs))
    first = F.row_number().over(Window.partitionBy("symbol", "zone_id").orderBy("created_t"))
    return specs.withColumn("no", first).where("no = 1").drop("no")
