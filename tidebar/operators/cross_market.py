"""A series against its references on the exact grid of times: returns, relative strength, correlation, beta, volatility regimes, health.

A value at t needs its bars at exactly t, t - step, ...; nothing is carried over a gap. A series' own windows are ranges of t, so only pairs are joined, on
(reference, t). (symbol, t) is unique and on the grid, as ``integrity.last_prints`` and ``integrity.issues`` ensure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bars of a window, least move that is not quiet, factors of expanded and compressed volatility, least return of a regime.
WINDOW, SYNC, EXPANDED, COMPRESSED, REGIME = 24, 0.001, 1.5, 0.75, 0.005


def _log_ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.ln(a / b))


def series_states(bars: DataFrame, minutes: int, window: int = WINDOW) -> DataFrame:
    """symbol, t, prior (the bar before is there), r1, rw, full (all returns of the window are there), vol, regime, volatility, vol_reason."""
    if window < 3:
        raise ValueError("window must be at least 3")
    step = 60 * minutes
    s = Window.partitionBy("symbol").orderBy("t")
    back = lambda c, k: F.max(c).over(s.rangeBetween(-k * step, -k * step))
    inside = s.rangeBetween((1 - window) * step, 0)
    df = bars.select("symbol", "t", "c", back("c", 1).alias("c1"), back("c", window).alias("cw"))
    df = df.select("symbol", "t", F.col("c1").isNotNull().alias("prior"), _log_ratio(F.col("c"), F.col("c1")).alias("r1"), _log_ratio(F.col("c"), F.col("cw")).alias("rw"))
    df = df.withColumn("full", F.count("r1").over(inside) == window).withColumn("vol", F.when(F.col("full"), F.stddev_pop("r1").over(inside)))
    df = df.withColumn("base", F.nullif(back("vol", window), F.lit(0.0)))
    vol, base, rw = F.col("vol"), F.col("base"), F.col("rw")
    volatility = F.when(vol.isNull() | base.isNull(), "unknown").when(vol > base * EXPANDED, "expanded").when(vol < base * COMPRESSED, "compressed").otherwise("normal")
    reason = F.when(vol.isNull(), "btc_vol_gap_or_short").when(base.isNull(), "btc_vol_no_baseline").otherwise(F.concat(F.lit("btc_volatility_"), volatility))
    regime = F.when(rw.isNull(), "unknown").when(rw > REGIME, "bullish").when(rw < -REGIME, "bearish").otherwise("neutral")
    return df.select("symbol", "t", "prior", "r1", "rw", "full", "vol", regime.alias("regime"), volatility.alias("volatility"), reason.alias("vol_reason"))


def move(a: Column, b: Column, sync: float = SYNC) -> Column:
    same = (a > 0) == (b > 0)
    return F.when(a.isNull() | b.isNull(), "unknown").when((F.abs(a) < sync) | (F.abs(b) < sync), "quiet").when(same & (a > 0), "synchronized_breakout").when(same & (a < 0), "synchronized_breakdown").otherwise("decoupled")


def pair_states(states: DataFrame, pairs: DataFrame, minutes: int, window: int = WINDOW, sync: float = SYNC) -> DataFrame:
    """focal, reference, t, health, strength, strength_window, corr, beta, move, evidence (an array) for every bar of each pair's focal series."""
    mine = states.select(F.col("symbol").alias("focal"), "t", *[F.col(c).alias(f"f_{c}") for c in ("prior", "r1", "rw", "full")]).join(pairs.select("focal", "reference"), "focal")
    other = states.select(F.col("symbol").alias("reference"), "t", *[F.col(c).alias(f"r_{c}") for c in ("prior", "r1", "rw", "full")])
    both = mine.join(other, ["reference", "t"], "left")
    w = Window.partitionBy("focal", "reference").orderBy("t").rangeBetween((1 - window) * 60 * minutes, 0)
    there, full = F.col("r_full").isNotNull(), F.col("f_full") & F.coalesce("r_full", F.lit(False))
    vf, vr = F.var_pop("f_r1").over(w), F.var_pop("r_r1").over(w)
    cov = F.covar_pop("f_r1", "r_r1").over(w)
    # the bar before must be there on both sides before either return counts
    prior = F.col("f_prior") & F.coalesce("r_prior", F.lit(False))
    both = both.select("focal", "reference", "t", there.alias("there"), prior.alias("prior"), full.alias("full"), F.when(prior, F.col("f_r1")).alias("a"), F.when(prior, F.col("r_r1")).alias("b"),
        (F.col("f_rw") - F.col("r_rw")).alias("strength_window"), F.when(full & (vf > 0) & (vr > 0), cov / F.sqrt(vf * vr)).alias("corr"), F.when(full & (vr > 0), cov / vr).alias("beta"))
    strength, moved = F.col("a") - F.col("b"), move(F.col("a"), F.col("b"), sync)
    bar = F.when(~F.col("there"), "missing_aligned_candle").when(~F.col("prior"), "missing_prior_aligned_candle").when(strength.isNull(), "non_positive_close")
    wide = F.when(F.col("there") & ~F.col("full"), "gap_or_short_window").when(F.col("there") & (F.col("corr").isNull() | F.col("beta").isNull()), "undefined_corr_or_beta")
    health = F.when(bar.isNotNull(), "unknown").when(wide.isNotNull(), "degraded").otherwise("valid")
    named = F.when(~moved.isin("unknown", "quiet"), F.concat_ws("_", "focal", "reference", moved))
    evidence = F.array_compact(F.array(bar, wide, named, F.when(F.abs(strength) >= sync, "relative_strength_nonzero")))
    return both.select("focal", "reference", "t", health.alias("health"), strength.alias("strength"), "strength_window", "corr", "beta", moved.alias("move"), evidence.alias("evidence"))


def cross_market(bars: DataFrame, first: str, second: str, minutes: int, native: str | None = None, window: int = WINDOW, sync: float = SYNC) -> DataFrame:
    """Every bar of every other series against the first and second reference, and the second against the first, with the first's regimes.

    ``native`` names a series of the ratio itself. evidence is an array of distinct reasons, in order.
    """
    if sync <= 0:
        raise ValueError("sync must be positive")
    states = series_states(bars, minutes, window)
    references = [c for c in (first, second, native) if c]
    names = states.select("symbol").distinct()
    others = names.where(~F.col("symbol").isin(references)).select(F.col("symbol").alias("focal"), F.explode(F.array(F.lit(first), F.lit(second))).alias("reference"))
    pairs = pair_states(states, others.unionByName(names.where(F.col("symbol") == second).select(F.col("symbol").alias("focal"), F.lit(first).alias("reference"))), minutes, window, sync)
    kept = ("health", "strength", "strength_window", "corr", "beta", "move", "evidence")
    side = lambda prefix, on: [*on, *[F.col(c).alias(f"{prefix}_{c}") for c in kept]]
    out = pairs.where((F.col("focal") != second) & (F.col("reference") == first)).select(*side("first", [F.col("focal").alias("symbol"), "t"]))
    out = out.join(pairs.where(F.col("reference") == second).select(*side("second", [F.col("focal").alias("symbol"), "t"])), ["symbol", "t"], "left")
    out = out.join(pairs.where(F.col("focal") == second).select(*side("between", ["t"])), "t", "left")
    out = out.join(states.where(F.col("symbol") == first).select("t", "regime", "volatility", F.col("vol").alias("realized_vol"), "vol_reason"), "t", "left")
    # the first reference is missing, not merely late, before its first bar
    began = bars.where(F.col("symbol") == first).select(F.min("t")).scalar()
    late = F.when(F.col("vol_reason").isNotNull(), F.col("vol_reason")).when(began <= F.col("t"), "btc_not_aligned_at_eval").otherwise("missing_btc")
    ratio = F.lit(None).cast("double")
    if native:
        out = out.join(states.where(F.col("symbol") == native).select("t", F.col("r1").alias("native_return")), "t", "left")
        ratio = F.col("native_return")
    moved, alone = F.col("first_move"), F.col("second_health") == "unknown"
    health = F.when(F.col("first_health") == "unknown", "unknown").when((F.col("first_health") == "degraded") | alone, "degraded").otherwise("valid")
    regime = F.coalesce("regime", F.lit("unknown"))
    more = F.array_compact(F.array(late, F.when(alone, "eth_unavailable_or_unaligned"), F.when(ratio.isNull() & F.lit(bool(native)), "native_avaxbtc_unaligned"), F.when(regime != "unknown", F.concat(F.lit("btc_regime_"), regime))))
    flags = [F.when(moved != "unknown", moved == f).alias(f) for f in ("synchronized_breakout", "synchronized_breakdown", "decoupled")]
    numbers = [F.col(f"{p}_{c}") for p in ("first", "second", "between") for c in ("strength", "strength_window", "corr", "beta")]
    words = [F.coalesce(f"{p}_{c}", F.lit("unknown")).alias(f"{p}_{c}") for p in ("first", "second", "between") for c in ("health", "move")]
    return out.select("symbol", "t", health.alias("health"), *words, *numbers, ratio.alias("native_return"), regime.alias("regime"), F.coalesce("volatility", F.lit("unknown")).alias("volatility"), "realized_vol", *flags, F.array_distinct(F.concat("first_evidence", more)).alias("evidence"))
