"""Quantile forecasts by ridge on many features, walked forward over long series.

A block of bars, with the bars before it that its first windows reach and those after it that its last outcomes need, is one grouped map; neighbouring blocks share only these. Within a block the normal equations of
all origins are differences of running sums of outer products, which begin anew with each block, so that they cost one pass and lose no digits; the spread of a window's residuals is read off its order statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .forecasts import drifts

#: The quantiles, the penalty, the first bar of a window that has features, the least rows of a fit and the least of a probability.
QUANTILES, PENALTY, FEATURE_BARS, LEAST, LEAST_SIGNED = (0.1, 0.5, 0.9), 8.0, 24, 30, 8
BLOCK = 4096


def model_inputs(bars: DataFrame, features: DataFrame, names: Sequence[str]) -> DataFrame:
    """symbol, t, n, c, drift and x, an array of the named features; one that is null or not finite is 0."""
    sound = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c))
    rows = drifts(bars).join(features.select("symbol", "t", F.array(*map(sound, names)).alias("x")), ["symbol", "t"])
    return rows.select("symbol", "t", "n", "last", "c", F.coalesce("drift", F.lit(0.0)).alias("drift"), "x")


def window_series(bars: DataFrame, first: int = 120, step: int = 20, lookback: int = 400) -> DataFrame:
    """Each origin's window as a series of its own (symbol@t of the origin), for features whose averages begin anew in every window. A bar is copied into lookback / step windows."""
    s = Window.partitionBy("symbol").orderBy("t")
    df = bars.withColumn("_n", F.row_number().over(s)).withColumn("_last", F.count("*").over(Window.partitionBy("symbol")))
    # windows by the number of their origin: the first at or after the bar, up to the last that still holds it
    begin = F.greatest(F.ceil((F.col("_n") - first) / step), F.lit(0)) * step + first
    end = F.least(F.col("_n") + lookback - 1, F.col("_last"))
    windows = F.when(begin <= end, F.sequence(begin, end, F.lit(step).cast("long")))
    return df.withColumn("_window", F.explode(windows)).withColumn("symbol", F.concat_ws("@", "symbol", "_window")).drop("_n", "_last", "_window")


def forecasts_of(n: np.ndarray, c: np.ndarray, drift: np.ndarray, x: np.ndarray, origins: np.ndarray, lookback: int, horizons: int) -> list[tuple]:
    """(row, training rows, h, q10, q50, q90, p_up, y) of the origins (indices) of a run of bars; n are the bars' numbers in their series, from 1."""
    bars, width = x.shape
    z = np.column_stack([np.ones(bars), x])
    with np.errstate(divide="ignore", invalid="ignore"):
        ahead = np.full((horizons, bars), np.nan)
        for h in range(1, horizons + 1):
            if bars > h:
                ahead[h - 1, :-h] = np.where((c[h:] > 0) & (c[:-h] > 0), np.log(c[h:] / c[:-h]), np.nan)
    steps = np.arange(1, horizons + 1)[:, None]
    left = ahead - steps * drift
    # a row is learnt from only with all its outcomes
    whole = ~np.isnan(ahead).any(axis=0)
    upper = np.triu_indices(width + 1)
    zero = lambda a: np.vstack([np.zeros((1, a.shape[1])), np.cumsum(a, axis=0)])
    products = zero((z[:, upper[0]] * z[:, upper[1]]) * whole[:, None])
    targets = np.concatenate([zero(np.nan_to_num(z * left[h][:, None]) * whole[:, None])[:, None] for h in range(horizons)], axis=1)
    penalty, out = PENALTY * np.diag([0.0, *[1.0] * width]), []
    for i in origins:
        # windows of lookback bars that end with the origin; their first FEATURE_BARS - 1 have no features, the last horizons no outcomes yet
        a = i - (min(lookback, n[i]) - 1) + FEATURE_BARS - 1
        b = i - horizons + 1
        rows = np.arange(max(a, 0), max(b, 0))
        rows = rows[whole[rows]]
        if len(rows) < LEAST:
            continue
        triangle = np.zeros((width + 1, width + 1))
        triangle[upper] = products[b] - products[a]
        triangle = triangle + triangle.T - np.diag(np.diag(triangle)) + penalty
        weights = np.linalg.solve(triangle, (targets[b] - targets[a]).T)
        spread = np.quantile(left[:, rows], QUANTILES, axis=1)
        centre = drift[i] * steps[:, 0] + z[i] @ weights
        bands = np.sort(centre + spread, axis=0)
        for h in range(horizons):
            score = drift[rows] * (h + 1)
            side = np.sign(bands[1, h]) == np.sign(score) if bands[1, h] != 0 else np.ones(len(rows), bool)
            p_up = float((ahead[h, rows[side]] > 0).mean()) if side.sum() >= LEAST_SIGNED else None
            y = ahead[h, i]
            out.append((int(i), len(rows), h + 1, *map(float, bands[:, h]), p_up, None if np.isnan(y) else float(y)))
    return out


def quantile_forecasts(inputs: DataFrame, first: int = 120, step: int = 20, lookback: int = 400, horizons: int = 10, latest: bool = False) -> DataFrame:
    """symbol, t, h, n_train, drift, q10, q50, q90, p_up, y for every step-th bar from the first-th on, or for each series' last bar alone; inputs as of model_inputs().

    The middle is drift and ridge, the band adds the quantiles of the training rows' residuals against drift alone, in order. An origin with fewer than LEAST training rows has none.
    """
    block = lambda n: F.floor(n / BLOCK).cast("long")
    n = F.col("n")
    # the blocks that need a bar: its own, those that look back on it, and the one before for its outcomes
    rows = inputs.withColumn("block", F.explode(F.sequence(block(F.greatest(n - horizons, F.lit(0))), block(n + lookback))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", ignore_index=True)
        n, own = pdf["n"].to_numpy(), pdf["block"].iloc[0]
        picked = (n // BLOCK == own) & ((n == pdf["last"].to_numpy()) if latest else ((n >= first) & ((n - first) % step == 0)))
        drift, c = pdf["drift"].to_numpy(), pdf["c"].to_numpy()
        found = forecasts_of(n, c, drift, np.stack(pdf["x"].to_numpy()), np.flatnonzero(picked), lookback, horizons)
        columns = ["symbol", "t", "n_train", "h", "drift", "q10", "q50", "q90", "p_up", "y"]
        if not found:
            return pd.DataFrame([], columns=columns)
        at = [r[0] for r in found]
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "t": pdf["t"].to_numpy()[at], "n_train": [r[1] for r in found], "h": [r[2] for r in found], "drift": drift[at] * [r[2] for r in found], **{k: [r[j] for r in found] for j, k in enumerate(("q10", "q50", "q90", "p_up", "y"), 3)}})

    return rows.groupBy("symbol", "block").applyInPandas(run, "symbol string, t long, n_train int, h int, drift double, q10 double, q50 double, q90 double, p_up double, y double")


def quantile_scores(found: DataFrame) -> DataFrame:
    """symbol, h, n and the errors of zero, drift and q50, the losses of the quantiles, the band's coverage, and the difference of the errors of q50 and drift. Origins count that have all outcomes of their horizon."""
    y = F.col("y")
    out = [F.count("y").alias("n")]
    for name, p in {"zero": F.lit(0.0), "drift": F.col("drift"), "q50": F.col("q50")}.items():
        signed = F.when(p != 0, ((y > 0) == (p > 0)).cast("double"))
        out += [F.avg(F.abs(y - p)).alias(f"{name}_mae"), F.sqrt(F.avg((y - p) ** 2)).alias(f"{name}_rmse"), F.avg(signed).alias(f"{name}_hits")]
    for q, name in zip(QUANTILES, ("q10", "q50", "q90"), strict=True):
        out.append(F.avg(F.greatest(q * (y - F.col(name)), (q - 1) * (y - F.col(name)))).alias(f"{name}_pinball"))
    out.append(F.avg(y.between(F.col("q10"), F.col("q90")).cast("double")).alias("coverage"))
    scored = found.where("y is not null").groupBy("symbol", "h").agg(*out)
    return scored.withColumn("q50_less_drift", F.col("q50_mae") - F.col("drift_mae")).drop("zero_hits")
