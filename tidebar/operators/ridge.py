"""Ridge regression by normal equations: the sums are one aggregation or one window, and only they are solved in Python.

The intercept is not penalised. Rows with a null feature or target do not count.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(features: Sequence[str], target: str, window=None) -> tuple[Column, Column]:
    """The upper triangle of Z'Z by rows and Z'y for Z = (1, features), as arrays; over a window if one is given."""
    whole = F.col(target).isNotNull()
    for f in features:
        whole &= F.col(f).isNotNull()
    z = [F.lit(1.0), *(F.col(f) for f in features)]

    def total(x: Column) -> Column:
        s = F.sum(F.when(whole, x))
        return F.coalesce(s.over(window) if window else s, F.lit(0.0))

    return F.array(*[total(z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))]), F.array(*[total(x * F.col(target)) for x in z])


def weights(l2: float):
    """A vectorised function from moments to the weights, intercept first; null where no row counted."""

    @F.pandas_udf("array<double>")
    def solve(triangle: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for tri, b in zip(triangle, right, strict=True):
            a, upper = np.zeros((len(b), len(b))), np.triu_indices(len(b))
            a[upper] = tri
            a = a + a.T - np.diag(np.diag(a)) + l2 * np.diag([0.0, *[1.0] * (len(b) - 1)])
            out.append(np.linalg.solve(a, np.asarray(b, float)).tolist() if a[0, 0] else None)
        return pd.Series(out, dtype=object)

    return solve


def predicted(w: str, features: Sequence[str]) -> Column:
    return sum((F.col(w)[k] * F.col(f) for k, f in enumerate(features, 1)), F.col(w)[0])


def horizon_rows(bars: DataFrame, horizons: int = 10) -> DataFrame:
    """symbol, t, n, h, drift, r1, r3 and y, the log return to h bars later less drift * h, for every bar and horizon."""
    s = Window.partitionBy("symbol").orderBy("t")
    log = lambda a, b: F.when((a > 0) & (b > 0), F.ln(a / b))
    out = bars.select("symbol", "t", "c", F.row_number().over(s).alias("n"), *[log(F.col("c"), F.lag("c", k).over(s)).alias(f"r{k}") for k in (1, 3)], F.array(*[log(F.lead("c", h).over(s), F.col("c")) for h in range(1, horizons + 1)]).alias("ahead"))
    drift = F.when(F.col("n") >= 21, F.avg("r1").over(s.rowsBetween(-18, 0)))
    out = out.withColumn("drift", F.coalesce(drift, F.lit(0.0)))
    out = out.select("symbol", "t", "n", "drift", "r1", "r3", F.posexplode("ahead").alias("h", "y"))
    return out.withColumn("h", F.col("h") + 1).withColumn("y", F.col("y") - F.col("drift") * F.col("h"))


def quantile_forecast(bars: DataFrame, features: Sequence[str] = ("r1", "r3"), l2: float = 8.0, least: int = 30) -> DataFrame:
    """symbol, h, q10, q50, q90 at each symbol's last bar: drift, ridge and the quantiles of the training rows' residuals against drift alone, in order.

    Training origins start at the 24th bar and end eleven bars before the last; a symbol with fewer than ``least`` has no forecast.
    """
    rows = horizon_rows(bars).withColumn("last", F.max("n").over(Window.partitionBy("symbol")))
    train = rows.where("n >= 24 and n <= last - 10 and y is not null").dropna(subset=list(features))
    tri, right = moments(features, "y")
    fitted = train.groupBy("symbol", "h").agg(tri.alias("tri"), right.alias("right")).where(F.col("tri")[0] >= least)
    fitted = fitted.select("symbol", "h", weights(l2)("tri", "right").alias("w"))
    spread = train.groupBy("symbol", "h").agg(F.percentile("y", F.array(*map(F.lit, (0.1, 0.5, 0.9)))).alias("e"))
    now = rows.where("n = last").join(fitted, ["symbol", "h"]).join(spread, ["symbol", "h"])
    centre = F.col("drift") * F.col("h") + predicted("w", features)
    q = F.array_sort(F.transform("e", lambda e: e + centre))
    return now.select("symbol", "h", *[q[k].alias(name) for k, name in enumerate(("q10", "q50", "q90"))])


def walk_forward(bars: DataFrame, features: Sequence[str] = ("r1", "r3"), l2: float = 8.0, first: int = 120, step: int = 20, lookback: int = 400, least: int = 30) -> DataFrame:
    """symbol, h, n, ridge_mae, drift_mae, zero_mae over the origins; each is fitted on the bars before it whose ten outcomes have matured.

    The normal equations of all origins are running sums, so no origin is fitted by a pass of its own.
    """
    past = Window.partitionBy("symbol", "h").orderBy("t").rowsBetween(-lookback, -10)
    tri, right = moments(features, "y", past)
    origins = horizon_rows(bars).withColumn("tri", tri).withColumn("right", right)
    origins = origins.where((F.col("n") >= first) & ((F.col("n") - first) % step == 0) & F.col("y").isNotNull() & (F.col("tri")[0] >= least)).dropna(subset=list(features))
    scored = origins.withColumn("w", weights(l2)("tri", "right")).withColumn("d", F.col("drift") * F.col("h"))
    errors = {"ridge_mae": F.col("y") - predicted("w", features), "drift_mae": F.col("y"), "zero_mae": F.col("y") + F.col("d")}
    return scored.groupBy("symbol", "h").agg(F.count("*").alias("n"), *[F.avg(F.abs(e)).alias(name) for name, e in errors.items()])
