"""Connected components by alternating min-label steps; every step is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """node, component (the least node reachable) for every node of the edges (a, b).

    Each round hangs a node's neighbours on its least neighbour (large star), then its smaller ones (small star); done when the table
    no longer changes; a table that still changes after ``limit`` rounds is an error. A star's centre is never grouped with its members: only minima are aggregated.
    """
    links = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(limit):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("m", "a").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = durable(large)
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), "m")
        near = large.join(low, F.col("a") == F.col("of"))
        small = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("of").alias("a"), F.col("m").alias("b"))).distinct()
        new = durable(small)
        same = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        if new.agg(same, F.count("*")).first() == links.agg(same, F.count("*")).first():
            break
        links = new
    else:
        raise RuntimeError(f"components have not settled after {limit} rounds")
    labels = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
