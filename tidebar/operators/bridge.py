"""Feature rows of earlier schemas, and rows as an upstream strategy names them; and what is put beside a snapshot: an analysis by regime, and theses bound to stored ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_attach
from .recurrences import with_recurrences
from .resample import resample

#: Windows of returns, of the volume's mean and of volatility; the hours and days that scale the clock; horizons of labels.
RETURNS, WINDOW, HOURS, DAYS, LABELS = (1, 3, 12, 24), 12, 23.0, 6.0, 10


def _zero(c: Column) -> Column:
    """0 for what is not there or not finite."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def _log(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.ln(a / b))


def legacy_rows(bars: DataFrame, minutes: int, parents: dict[str, int]) -> DataFrame:
    """symbol, t and twelve features from the second bar on: log returns, range, body, volume ratio, distances from averages, volatility of log returns, and the last return of complete parents.

    A window that is not full, a return over a close that is not positive and a division by zero give 0, not null.
    """
    s = Window.partitionBy("symbol").orderBy("t")
    c = F.col("c")
    df = with_recurrences(bars, spans=(9, 20)).withColumn("n", F.row_number().over(s)).withColumn("r", _log(c, F.lag("c").over(s)))
    w = s.rowsBetween(1 - WINDOW, 0)
    full = F.col("n") >= WINDOW
    volume = F.when(full, F.col("v") / F.nullif(F.avg("v").over(w), F.lit(0.0)))
    volatility = F.when((F.col("n") > WINDOW) & (F.count("r").over(w) >= 2), F.stddev_pop("r").over(w))
    values = {f"logret_{k}": _log(c, F.lag("c", k).over(s)) for k in RETURNS}
    values |= {"range_pct": (F.col("h") - F.col("l")) / F.nullif(c, F.lit(0.0)), "body_pct": F.abs(c - F.col("o")) / F.nullif(F.col("o"), F.lit(0.0)), f"vol_ratio_{WINDOW}": volume}
    values |= {f"ema{k}_dist": (c - F.col(f"ema{k}")) / F.nullif(c, F.lit(0.0)) for k in (9, 20)} | {f"realized_vol_{WINDOW}": volatility}
    out = df.select("symbol", "t", "n", *[_zero(v).alias(k) for k, v in values.items()]).withColumn("known", F.col("t") + 60 * minutes)
    for label, width in parents.items():
        above = resample(bars, minutes, width)
        above = above.select("symbol", (F.col("t") + 60 * width).alias("known_"), _zero(_log(F.col("c"), F.lag("c").over(s))).alias(f"htf_{label}_logret_1"))
        out = asof_attach(out, above, "known", "known_", [f"htf_{label}_logret_1"])
    parents_ = [f"htf_{p}_logret_1" for p in parents]
    return out.where("n >= 2").select("symbol", "t", *values, *[F.coalesce(p, F.lit(0.0)).alias(p) for p in parents_])


def strategy_rows(bars: DataFrame, period: int = 14) -> DataFrame:
    """symbol, t, features (%-) and labels (&-) as the upstream strategy names them. Labels look ahead and are never features; null where there is no later bar."""
    s = Window.partitionBy("symbol").orderBy("t")
    c = F.col("c")
    w = s.rowsBetween(1 - period, 0)
    df = with_recurrences(bars, spans=(), period=period)
    over = lambda a, b: a / F.nullif(b, F.lit(0.0))
    day = F.floor(F.col("t") / 86400)
    features = {
        "%-rsi-period": F.col(f"rsi{period}"),
        "%-roc-period": (over(c, F.lag("c", period).over(s)) - 1) * 100,
        "%-rel-volume-period": F.when(F.count("v").over(w) == period, over(F.col("v"), F.avg("v").over(w))),
        "%-ret-1": over(c, F.lag("c").over(s)) - 1,
        "%-range-pct": over(F.col("h") - F.col("l"), c),
        "%-body-pct": over(c - F.col("o"), F.col("o")),
        "%-raw-volume": F.col("v"),
        "%-hour": F.floor(F.pmod("t", F.lit(86400)) / 3600) / HOURS,
        # the epoch was a Thursday; Monday is 0
        "%-day-of-week": F.pmod(day + 3, F.lit(7)) / DAYS,
    }
    labels = {f"&-cum-ret-{h}": over(F.lead("c", h).over(s), c) - 1 for h in range(1, LABELS + 1)}
    return df.select("symbol", "t", *[v.alias(k) for k, v in (features | labels).items()])


def analysis(snaps: DataFrame, timeframes: list[str]) -> DataFrame:
    """symbol, t, primary_regime (the first decided of the timeframes, longest first), bull_case and bear_case: the timeframes that speak for either."""
    regimes = F.array_compact(F.array(*[F.when(F.col(f"{n}.regime").isNotNull(), F.struct(F.lit(n).alias("timeframe"), F.col(f"{n}.regime").alias("regime"), F.col(f"{n}.swing").alias("swing"))) for n in timeframes]))
    df = snaps.select("symbol", "t", regimes.alias("regimes"))
    side = lambda regime: F.transform(F.filter("regimes", lambda r: r["regime"] == regime), lambda r: F.concat(r["timeframe"], F.lit(":"), r["swing"]))
    first = F.get(F.filter("regimes", lambda r: r["regime"].isin("bullish", "bearish")), F.lit(0))["regime"]
    return df.select("symbol", "t", F.coalesce(first, F.lit("neutral")).alias("primary_regime"), F.array_join(side("bullish"), ",").alias("bull_case"), F.array_join(side("bearish"), ",").alias("bear_case"))


def bound_theses(theses: DataFrame, stored: DataFrame) -> DataFrame:
    """theses (symbol, thesis_id, created_at, invalidation_rules, invalidation_fingerprint and more) with the stored ones' creation and invalidation where there is one, and ledger: journaled or ephemeral."""
    fixed = ("created_at", "invalidation_rules", "invalidation_fingerprint")
    old = stored.select("symbol", "thesis_id", *[F.col(c).alias(f"stored_{c}") for c in fixed], F.lit(True).alias("there"))
    df = theses.join(old, ["symbol", "thesis_id"], "left")
    for c in fixed:
        df = df.withColumn(c, F.coalesce(f"stored_{c}", c))
    return df.withColumn("ledger", F.when(F.col("there"), "journaled").otherwise("ephemeral")).select(*theses.columns, "ledger")
