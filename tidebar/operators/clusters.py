"""Greedy one-dimensional clusters of prices.

In order of price, a value joins the running cluster if it lies within ``tolerance`` of the cluster's mean. The mean never exceeds the last value,
so a step of more than the tolerance always begins a cluster; series are cut there first, and only each
stretch between such steps is folded in order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_attach
from .swings import LEAST_WIDTH, widened, zone_ids

#: A fixed value: the tolerance of a cluster, relative.
TOLERANCE = 0.006


def greedy(prices: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
    """The number of each ascending price's cluster."""
    out, total, size, at = np.zeros(len(prices), dtype=np.int64), 0.0, 0, -1
    for k, p in enumerate(prices):
        centre = total / size if size else None
        if centre is None or abs(p - centre) / max(centre, 1e-12) > tolerance:
            at, total, size = at + 1, 0.0, 0
        total, size = total + p, size + 1
        out[k] = at
    return out


def clustered(pivots: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """pivots (symbol, t, price, kind and more) with the cluster (stretch, no) that each belongs to."""
    by = Window.partitionBy("symbol").orderBy("price", "t", "kind")
    before = F.lag("price").over(by)
    new = F.when(before.isNull() | (F.col("price") - before > tolerance * F.greatest(before, F.lit(1e-12))), 1).otherwise(0)
    cut = pivots.withColumn("new", new).withColumn("stretch", F.sum("new").over(by)).drop("new")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("price", kind="stable")
        return pdf.assign(no=greedy(pdf["price"].to_numpy(), tolerance))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return cut.groupBy("symbol", "stretch").applyInPandas(fold, f"{schema}, no long")


def _strength(touches: Column) -> Column:
    return F.least(F.lit(1.0), 0.2 + 0.15 * touches)


def zone_clusters(pivots: DataFrame, closes: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """symbol, lower, upper, touches, role, strength for pivots (symbol, t, price, kind) and the current close (symbol, c)."""
    found = clustered(pivots.select("symbol", "t", "price", "kind"), tolerance)
    zones = found.groupBy("symbol", "stretch", "no").agg(F.min("price").alias("lower"), F.max("price").alias("upper"), F.count("*").alias("touches"), F.countDistinct("kind").alias("kinds"))
    middle = (F.col("lower") + F.col("upper")) / 2
    role = F.when((F.col("kinds") > 1) & (F.abs(middle - F.col("c")) < tolerance * F.col("c")), "mixed").when(middle < F.col("c"), "support").when(middle > F.col("c"), "resistance").otherwise("mixed")
    return zones.join(closes, "symbol").select("symbol", "lower", "upper", "touches", role.alias("role"), _strength(F.col("touches")).alias("strength"))


def memberships(pivots: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """symbol, t, kind, price of every pivot with lower, upper of its zone: clusters do not overlap, so that a pivot's band is its cluster's."""
    found = clustered(pivots.select("symbol", "t", "price", "kind"), tolerance)
    zone = Window.partitionBy("symbol", "stretch", "no")
    return found.select("symbol", "t", "kind", "price", F.min("price").over(zone).alias("lower"), F.max("price").over(zone).alias("upper"))


def specs_at_formation(pivots: DataFrame, bars: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """symbol, lower, upper, role, strength, created_t, known_t, zone_id: the role is judged by the last close at known_t, the latest of the members' known times (of
    pivots: symbol, t, known_t, price, kind), and never again by later closes; before the first bar by the first close; a bar without a close makes it mixed. Thin bands are widened about their middle."""
    found = clustered(pivots.select("symbol", "t", "known_t", "price", "kind"), tolerance)
    zones = found.groupBy("symbol", "stretch", "no").agg(F.min("price").alias("lower"), F.max("price").alias("upper"), F.count("*").alias("touches"), F.min("t").alias("created_t"), F.max("known_t").alias("known_t"))
    first = bars.groupBy("symbol").agg(F.min_by("c", "t").alias("first_c"))
    zones = asof_attach(zones, bars.select("symbol", F.col("t").alias("open_t"), "c"), "known_t", "open_t", ["open_t", "c"]).join(first, "symbol")
    middle, c = (F.col("lower") + F.col("upper")) / 2, F.when(F.col("open_t").isNull(), F.col("first_c")).otherwise(F.col("c"))
    role = F.when(middle < c, "support").when(middle > c, "resistance").otherwise("mixed")
    return zone_ids(widened(zones.select("symbol", "lower", "upper", role.alias("role"), _strength(F.col("touches")).alias("strength"), "created_t", "known_t")))


def specs_now(zones: DataFrame, ranges: DataFrame, least: float = LEAST_WIDTH) -> DataFrame:
    """zones (symbol, lower, upper, role, strength) with bands widened about their middle to the greatest of ``least`` of it, a quarter of the symbol's average range
    (ranges: symbol, atr, which may be null) and 1e-8, and their zone_id."""
    middle = (F.col("lower") + F.col("upper")) / 2
    width = F.greatest(F.abs(F.when(middle == 0, 1.0).otherwise(middle)) * least, F.coalesce("atr", F.lit(0.0)) * 0.25, F.lit(1e-8))
    thin = F.col("upper") - F.col("lower") < width
    rows = zones.join(ranges.select("symbol", "atr"), "symbol", "left")
    lower, upper = F.when(thin, middle - width / 2).otherwise(F.col("lower")), F.when(thin, middle + width / 2).otherwise(F.col("upper"))
    return rows.select("symbol", lower.alias("lower"), upper.alias("upper"), "role", "strength").transform(zone_ids)
