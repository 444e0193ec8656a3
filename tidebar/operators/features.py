"""The feature history: every base bar with its own features, those of its last completed parents, and those against two companion series.

One pass for all times. Windows end at the current row; parents and companions attach by the time they are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_attach
from .recurrences import SPANS, with_recurrences
from .resample import resample

#: The windows of returns, the length of rolling statistics, the bars of a slope, the factor of an expansion, and the least move of a synchronous bar.
RETURNS, PARENT_RETURNS, CROSS_RETURNS, RELATIVE_RETURNS = (1, 2, 3, 6, 12, 24, 48), (1, 2, 3, 6, 12), (1, 12, 24), (1, 3, 12, 24)
WIDE, SLOPE, EXPANSION, QUIET = 24, 3, 1.5, 0.001
#: The feature names of a timeframe, in their order, after its returns.
NAMES = (
    "body_ratio", "upper_wick_ratio", "lower_wick_ratio", "range_pct", "close_loc", "dist_rolling_high_24", "dist_rolling_low_24", "rsi14", "rsi14_centered",
    "atr14", "atr14_pct", "realized_vol_24", "vol_z_24", "vol_ratio_24", "vol_expansion", "ema_stack_score",
)


def timeframe_names(prefix: str, windows: tuple[int, ...]) -> list[str]:
    emas = [f"ema{s}_{kind}" for s in SPANS for kind in ("dist", "slope")]
    return [f"{prefix}{n}" for n in [*(f"logret_{w}" for w in windows), *NAMES, *emas]]


def feature_names(own: str = "avax", base: str = "5m", parents: tuple[str, ...] = ("15m", "1h", "4h", "1d"), companions: tuple[str, ...] = ("btc", "eth")) -> list[str]:
    """The ordered schema of a feature row."""
    out = timeframe_names(f"{own}_{base}_", RETURNS)
    for p in parents:
        out += timeframe_names(f"{own}_{p}_", PARENT_RETURNS)
    out += [f"{c}_{base}_logret_{w}" for w in CROSS_RETURNS for c in companions] + [f"{c}_{base}_realized_vol_24" for c in companions]
    out += [f"rel_{own}_{c}_logret_{w}" for w in RELATIVE_RETURNS for c in companions]
    return out + [f"rel_{own}_{c}_{kind}_24" for kind in ("corr", "beta") for c in companions] + [f"rel_sync_{c}_1" for c in companions]


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def _log_return(s, k: int, c: str = "c") -> Column:
    return F.when((F.col(c) > 0) & (F.lag(c, k).over(s) > 0), F.ln(F.col(c) / F.lag(c, k).over(s)))


def _volatility(df: DataFrame, s) -> DataFrame:
    df = df.withColumn("x", _ratio(F.col("c"), F.lag("c").over(s)) - 1)
    w = s.rowsBetween(1 - WIDE, 0)
    return df.withColumn("realized_vol_24", F.when(F.count("x").over(w) == WIDE, F.stddev_pop("x").over(w))).drop("x")


def timeframe_features(bars: DataFrame, prefix: str, windows: tuple[int, ...]) -> DataFrame:
    """symbol, t and the timeframe's features; null in warm-up."""
    s = Window.partitionBy("symbol").orderBy("t")
    w = s.rowsBetween(1 - WIDE, 0)
    df = _volatility(with_recurrences(bars), s)
    full, span, c = F.count("*").over(w) == WIDE, F.col("h") - F.col("l"), F.col("c")
    high, low, mean = F.max("h").over(w), F.min("l").over(w), F.avg("v").over(w)
    sound = full & (c > 0) & (high > 0) & (low > 0)
    part = lambda x: F.when(span > 0, x / span).otherwise(0.0)
    out = {f"logret_{k}": _log_return(s, k) for k in windows}
    out |= {
        "body_ratio": part(F.abs(c - F.col("o"))),
        "upper_wick_ratio": part(F.col("h") - F.greatest("o", "c")),
        "lower_wick_ratio": part(F.least("o", "c") - F.col("l")),
        "range_pct": F.when(span > 0, _ratio(span, c)).otherwise(0.0),
        "close_loc": F.when(span > 0, (c - F.col("l")) / span).otherwise(0.5),
        "dist_rolling_high_24": F.when(sound, c / high - 1),
        "dist_rolling_low_24": F.when(sound, c / low - 1),
        "rsi14": F.col("rsi14"),
        "rsi14_centered": (F.col("rsi14") - 50) / 50,
        "atr14": F.col("atr14"),
        "atr14_pct": F.when(c > 0, F.col("atr14") / c),
        "realized_vol_24": F.col("realized_vol_24"),
        "vol_z_24": F.when(full, _ratio(F.col("v") - mean, F.stddev_pop("v").over(w))),
        "vol_ratio_24": F.when(full, _ratio(F.col("v"), mean)),
        "vol_expansion": F.when(full, ((mean > 0) & (F.col("v") > EXPANSION * mean)).cast("double")),
    }
    line = ["c", *[f"ema{k}" for k in SPANS]]
    out["ema_stack_score"] = sum((F.signum(F.col(a) - F.col(b)) for a, b in zip(line, line[1:])), F.lit(0.0))
    for k in SPANS:
        before = F.lag(f"ema{k}", SLOPE).over(s)
        out |= {f"ema{k}_dist": F.when(c > 0, (c - F.col(f"ema{k}")) / c), f"ema{k}_slope": _ratio(F.col(f"ema{k}") - before, before)}
    return df.select("symbol", "t", *[out[n].alias(prefix + n) for n in timeframe_names("", windows)])


def _companion(bars: DataFrame, symbol: str, primaries: list[str], minutes: int, prefix: str) -> DataFrame:
    """A companion's own features, once for each primary, from the time they are known."""
    s = Window.partitionBy("symbol").orderBy("t")
    own = _volatility(bars.where(F.col("symbol") == symbol), s)
    own = own.select((F.col("t") + 60 * minutes).alias("known_"), *[_log_return(s, k).alias(f"{prefix}logret_{k}") for k in CROSS_RETURNS], F.col("realized_vol_24").alias(f"{prefix}realized_vol_24"))
    return own.withColumn("symbol", F.explode(F.array(*map(F.lit, primaries))))


def _relative(bars: DataFrame, symbol: str, minutes: int, prefix: str) -> DataFrame:
    """Of the bars that a primary has in common with a companion: differences of returns, correlation and beta over them."""
    other = bars.where(F.col("symbol") == symbol).select("t", F.col("c").alias("b"))
    rows = bars.select("symbol", "t", F.col("c").alias("a")).join(other, "t")
    s = Window.partitionBy("symbol").orderBy("t")
    w = s.rowsBetween(1 - WIDE, 0)
    rows = rows.withColumn("ra", _log_return(s, 1, "a")).withColumn("rb", _log_return(s, 1, "b"))
    whole = F.count(F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), 1)).over(w) == WIDE
    va, vb, cov = F.var_pop("ra").over(w), F.var_pop("rb").over(w), F.covar_pop("ra", "rb").over(w)
    return rows.select(
        "symbol", (F.col("t") + 60 * minutes).alias("known_"), *[(_log_return(s, k, "a") - _log_return(s, k, "b")).alias(f"{prefix}logret_{k}") for k in RELATIVE_RETURNS],
        F.when(whole & (va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias(f"{prefix}corr_24"), F.when(whole & (vb > 0), cov / vb).alias(f"{prefix}beta_24"),
    )


def feature_history(bars: DataFrame, minutes: int, parents: dict[str, int], companions: dict[str, str], primaries: list[str], own: str = "avax", base: str = "5m") -> DataFrame:
    """symbol, t, known, the time from which each parent is known, and feature_names() for every base bar of the primaries.

    parents: minutes by label; companions: symbols by label; primaries: the symbols that have rows.
    """
    chosen = bars.where(F.col("symbol").isin(primaries))
    out = timeframe_features(chosen, f"{own}_{base}_", RETURNS).withColumn("known", F.col("t") + 60 * minutes)
    attach = lambda df, right, time: asof_attach(df, right, "known", time, [c for c in right.columns if c != "symbol"])
    for label, parent in parents.items():
        prefix = f"{own}_{label}_"
        features = timeframe_features(resample(chosen, minutes, parent), prefix, PARENT_RETURNS)
        out = attach(out, features.withColumn(f"{label}_known", F.col("t") + 60 * parent).drop("t"), f"{label}_known")
    one = F.col(f"{own}_{base}_logret_1")
    for label, symbol in companions.items():
        out = attach(out, _companion(bars, symbol, primaries, minutes, f"{label}_{base}_"), "known_").drop("known_")
        out = attach(out, _relative(bars.where(F.col("symbol").isin(primaries) | (F.col("symbol") == symbol)), symbol, minutes, f"rel_{own}_{label}_"), "known_").drop("known_")
        two = F.col(f"{label}_{base}_logret_1")
        same = F.when(one.isNull() | two.isNull(), None).when((F.abs(one) < QUIET) | (F.abs(two) < QUIET), 0.0).otherwise(((one > 0) == (two > 0)).cast("double"))
        out = out.withColumn(f"rel_sync_{label}_1", same)
    names = feature_names(own, base, tuple(parents), tuple(companions))
    return out.select("symbol", "t", "known", *[f"{p}_known" for p in parents], *names)
