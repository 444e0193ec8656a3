import numpy as np
from pyspark.sql import functions as F

from tidebar.operators.clusters import greedy, zone_clusters
from tidebar.operators.ridge import moments, walk_forward, weights


def test_ridge_equals_numpy(spark):
    r = np.random.default_rng(3)
    x, y = r.normal(size=(60, 3)), r.normal(size=60)
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    tri, right = moments(["a", "b", "c"], "y")
    got = df.agg(tri.alias("tri"), right.alias("right")).select(weights(8.0)("tri", "right").alias("w")).first().w
    z = np.column_stack([np.ones(60), x])
    assert np.allclose(got, np.linalg.solve(z.T @ z + 8 * np.diag([0, 1, 1, 1]), z.T @ y))


def test_walk_forward_ignores_later_bars(spark):
    r = np.random.default_rng(5)
    prices = np.exp(np.cumsum(r.normal(0, 0.01, 220)))
    bars = spark.createDataFrame([("a", 14400 * k, float(p)) for k, p in enumerate(prices)], "symbol string, t long, c double")
    changed = bars.withColumn("c", F.when(F.col("t") > 14400 * 150, F.col("c") * 3).otherwise(F.col("c")))
    # the origins up to bar 140 have all outcomes by bar 150
    few = [walk_forward(b.where(f"t <= {14400 * 150}")).orderBy("h").collect() for b in (bars, changed)]
    assert few[0] == few[1] and len(few[0]) == 10


def test_clusters_equal_one_fold(spark):
    r = np.random.default_rng(7)
    rows = [(s, k, float(p), "high" if k % 2 else "low") for s in "ab" for k, p in enumerate(r.uniform(90, 110, 150).round(1))]
    pivots = spark.createDataFrame(rows, "symbol string, t long, price double, kind string")
    closes = spark.createDataFrame([("a", 100.0), ("b", 95.0)], "symbol string, c double")
    got = sorted((z.symbol, z.lower, z.upper, z.touches) for z in zone_clusters(pivots, closes).collect())
    want = []
    for s in "ab":
        p = np.sort([x[2] for x in rows if x[0] == s])
        no = greedy(p)
        want += [(s, p[no == k].min(), p[no == k].max(), int((no == k).sum())) for k in range(no.max() + 1)]
    assert got == sorted(want)


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([], "symbol string, t long, price double, kind string")
    assert zone_clusters(none, spark.createDataFrame([("a", 1.0)], "symbol string, c double")).count() == 0
