"""Journals of forecasts and their outcomes: maturation, scores, catch-up, inspection, and the merge with walk-forward scores.

Times are epoch seconds. A forecast is (symbol, forecast_id, forecasted_at, origin_close); its horizons are rows (symbol, forecast_id, forecasted_at, source, h,
p, q10, q90, point); an outcome is (symbol, forecast_id, h, matured_at, realized, above). Tables only grow; a key that is stored is not written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .forecasts import HORIZONS, drifts

#: The sources that count as live, the least numbers for a score and for a calibration error, its bins, the first index and least bars of a catch-up, and its budget.
LIVE = ("binance-vision", "live")
LEAST, LEAST_CALIBRATION, BINS, FIRST, LEAST_BARS, BUDGET = 8, 15, 5, 20, 31, 24


def data_source(raw: Column) -> Column:
    return F.when(raw.isin(*LIVE), "live").when(raw == "fixture", "fixture").otherwise("unknown")


def matured(forecasts: DataFrame, bars: DataFrame, minutes: int, as_of: int | None = None, stored: DataFrame | None = None) -> DataFrame:
    """symbol, forecast_id, h, matured_at, realized, above, realized_close: outcomes known at as_of that are not stored. A forecast belongs to the bar that
    closed at its time, h counts later bars; closes that are not positive have no outcome."""
    width = 60 * minutes
    if as_of is not None:
        bars = bars.where(F.col("t") <= as_of - width)
    s = Window.partitionBy("symbol").orderBy("t")
    ahead = F.array(*[F.struct(F.lit(h).alias("h"), (F.lead("t", h).over(s) + width).alias("matured_at"), F.lead("c", h).over(s).alias("realized_close")) for h in range(1, HORIZONS + 1)])
    closing = bars.select("symbol", (F.col("t") + width).alias("forecasted_at"), ahead.alias("ahead"))
    rows = forecasts.select("symbol", "forecast_id", "forecasted_at", "origin_close").join(closing, ["symbol", "forecasted_at"])
    rows = rows.select("symbol", "forecast_id", "origin_close", F.inline("ahead")).where("realized_close > 0 and origin_close > 0")
    if stored is not None:
        rows = rows.join(stored.select("forecast_id", "h"), ["forecast_id", "h"], "left_anti")
    return rows.select("symbol", "forecast_id", "h", "matured_at", F.ln(F.col("realized_close") / F.col("origin_close")).alias("realized"), (F.col("realized_close") > F.col("origin_close")).alias("above"), "realized_close")


def scores(horizons: DataFrame, outcomes: DataFrame, as_of: int | None = None) -> DataFrame:
    """By symbol and h: counts, brier, ece, those of live forecasts alone, coverage, and errors of zero and of the point; null below the least numbers.

    A forecast and an outcome count once they are known at as_of. Sums are taken by bin first, so that ece needs no rows of its own.
    """
    rows = horizons.join(outcomes.select("symbol", "forecast_id", "h", "matured_at", "realized", "above"), ["symbol", "forecast_id", "h"])
    if as_of is not None:
        rows = rows.where((F.col("forecasted_at") <= as_of) & (F.col("matured_at") <= as_of))
    y, p, live = F.col("above").cast("double"), F.col("p"), data_source(F.col("source")) == "live"
    scored = p.isNotNull() & y.isNotNull()
    ranged, pointed = F.col("q10").isNotNull() & F.col("q90").isNotNull() & F.col("realized").isNotNull(), F.col("point").isNotNull() & F.col("realized").isNotNull()
    off = F.col("realized") - F.col("point")
    values = {"n": (scored, F.lit(1)), "p": (scored, p), "y": (scored, y), "b": (scored, (p - y) * (p - y)), "ln": (scored & live, F.lit(1)), "lp": (scored & live, p), "ly": (scored & live, y), "lb": (scored & live, (p - y) * (p - y)),
        "ni": (ranged, F.lit(1)), "hit": (ranged, F.col("realized").between(F.col("q10"), F.col("q90")).cast("int")), "np": (pointed, F.lit(1)), "zm": (pointed, F.abs("realized")), "zr": (pointed, F.col("realized") * F.col("realized")), "dm": (pointed, F.abs(off)), "dr": (pointed, off * off)}
    bins = rows.groupBy("symbol", "h", F.least(F.lit(BINS - 1), F.floor(p * BINS)).alias("bin")).agg(*[F.coalesce(F.sum(F.when(test, v)), F.lit(0)).alias(k) for k, (test, v) in values.items()])
    total = {k: F.sum(k) for k in values}
    least = lambda n, k, v: F.when(n >= k, v)
    n, live_n, points = total["n"], total["ln"], total["np"]
    return bins.groupBy("symbol", "h").agg(
        n.alias("n_p"), least(n, LEAST, total["b"] / n).alias("brier"), least(n, LEAST_CALIBRATION, F.sum(F.abs(F.col("p") - F.col("y"))) / n).alias("ece"),
        live_n.alias("n_live"), least(live_n, LEAST, total["lb"] / live_n).alias("live_brier"), least(live_n, LEAST_CALIBRATION, F.sum(F.abs(F.col("lp") - F.col("ly"))) / live_n).alias("live_ece"),
        total["ni"].alias("n_interval"), least(total["ni"], LEAST, total["hit"] / total["ni"]).alias("coverage"),
        points.alias("n_point"), least(points, LEAST, total["zm"] / points).alias("zero_mae"), least(points, LEAST, F.sqrt(total["zr"] / points)).alias("zero_rmse"),
        least(points, LEAST, total["dm"] / points).alias("drift_mae"), least(points, LEAST, F.sqrt(total["dr"] / points)).alias("drift_rmse"))


def catch_up(bars: DataFrame, journaled: DataFrame, minutes: int, budget: int = BUDGET) -> DataFrame:
    """The first ``budget`` of a symbol's bars with all their later bars that have no forecast yet: symbol, forecasted_at, origin_close, drift, and remaining,
    how many such bars are left after these. The budget is what one round may write; rounds go on until nothing remains."""
    rows = drifts(bars).where((F.col("last") >= LEAST_BARS) & (F.col("n") > FIRST) & (F.col("n") <= F.col("last") - HORIZONS))
    rows = rows.select("symbol", (F.col("t") + 60 * minutes).alias("forecasted_at"), F.col("c").alias("origin_close"), "drift")
    rows = rows.join(journaled.select("symbol", "forecasted_at"), ["symbol", "forecasted_at"], "left_anti")
    by = Window.partitionBy("symbol")
    rows = rows.withColumn("k", F.row_number().over(by.orderBy("forecasted_at"))).withColumn("remaining", F.greatest(F.lit(0).cast("long"), F.count("*").over(by) - budget))
    return rows.where(F.col("k") <= budget).drop("k")


def merged_scores(journal: DataFrame, walk: DataFrame) -> DataFrame:
    """Walk-forward scores by symbol and h (brier, ece, coverage, drift_mae, drift_rmse, gated_mae), each block replaced by the journal's where that has a score, with its source."""
    def block(name: str, first: str, columns: list[str]) -> list[Column]:
        there = F.col(f"j.{first}").isNotNull()
        source = F.when(there, "journal").otherwise("walk_forward")
        return [F.when(there, F.col(f"j.{c}")).otherwise(F.col(f"w.{c}")).alias(c) for c in columns] + [source.alias(f"{name}_source")]

    j = journal.select("symbol", "h", "brier", "ece", "coverage", "drift_mae", "drift_rmse").alias("j")
    rows = walk.alias("w").join(j, (F.col("w.symbol") == F.col("j.symbol")) & (F.col("w.h") == F.col("j.h")), "left")
    rows = rows.select("w.symbol", "w.h", *block("probability", "brier", ["brier", "ece"]), *block("interval", "coverage", ["coverage"]), *block("drift", "drift_mae", ["drift_mae", "drift_rmse"]), "w.gated_mae")
    # a difference compares errors of the same source only
    return rows.withColumn("gated_minus_drift", F.when(F.col("drift_source") == "walk_forward", F.col("gated_mae") - F.col("drift_mae")))


def inspected(horizons: DataFrame) -> DataFrame:
    """symbol, forecast_id, h, status, issues for each of the ten horizons of every forecast, and for others that it has. horizons: symbol, forecast_id, i, h, p,
    q10, q50, q90, expected; of several rows of one h the first by i is judged. Rows without h are not read."""
    rows = horizons.where("h is not null")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    copies = rows.groupBy("symbol", "forecast_id", "h").agg(F.count("*").alias("copies"), F.min_by(F.struct("p", "q10", "q50", "q90", "expected"), "i").alias("x"))
    slots = horizons.select("symbol", "forecast_id").distinct().select("symbol", "forecast_id", F.explode(F.sequence(F.lit(1), F.lit(HORIZONS))).alias("h"))
    both = slots.join(copies.withColumn("h", F.col("h").cast("int")), ["symbol", "forecast_id", "h"], "full")
    q, p = [F.col(f"x.{c}") for c in ("q10", "q50", "q90")], F.col("x.p")
    whole = number(q[0]) & number(q[1]) & number(q[2])
    outside = ~F.col("h").between(1, HORIZONS)
    found = F.array_compact(F.array(
        F.when(F.col("copies") > 1, "duplicate-horizon"), F.when(~whole, "missing-quantile").when((q[0] > q[1]) | (q[1] > q[2]), "crossed-quantiles"),
        F.when(~number(F.col("x.expected")), "non-finite-expected"), F.when(~number(p), "non-finite-probability").when((p < 0) | (p > 1), "probability-out-of-range")))
    issues = F.when(F.col("copies").isNull(), F.array(F.lit("missing-horizon"))).when(outside, F.array(F.lit("horizon-out-of-range"))).otherwise(found)
    blocking = F.arrays_overlap("issues", F.array(*map(F.lit, ("missing-quantile", "crossed-quantiles", "horizon-out-of-range", "duplicate-horizon"))))
    status = F.when(F.array_contains("issues", "missing-horizon"), "missing").when(blocking, "rejected").otherwise("ok")
    return both.select("symbol", "forecast_id", "h", issues.alias("issues")).select("symbol", "forecast_id", "h", status.alias("status"), "issues")
