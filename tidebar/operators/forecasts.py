"""Drift forecasts, their gate by parent bars, and walk-forward scores, in DataFrame operations.

The closes of the next bars come from one window with a lead for each horizon; no bar is joined with others of its series. An origin's scores
use only outcomes that were known at the origin: outcomes and origins stand in one running window by the bar at which they are known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_attach
from .resample import resample

#: Horizons, returns in a drift, and the least numbers of matured origins for a probability, an interval, and a calibration error.
HORIZONS, DRIFT, LEAST, LEAST_CALIBRATION, BINS = 10, 19, 8, 15, 5


def drifts(bars: DataFrame) -> DataFrame:
    """symbol, t, c, n (from 1), last and drift, the mean of the last 19 log returns, null before the 21st bar."""
    s = Window.partitionBy("symbol").orderBy("t")
    r = F.when((F.col("c") > 0) & (F.lag("c").over(s) > 0), F.ln(F.col("c") / F.lag("c").over(s)))
    df = bars.select("symbol", "t", "c", r.alias("r")).withColumn("n", F.row_number().over(s)).withColumn("last", F.count("*").over(Window.partitionBy("symbol")))
    return df.withColumn("drift", F.when(F.col("n") > DRIFT + 1, F.avg("r").over(s.rowsBetween(1 - DRIFT, 0)))).drop("r")


def outcomes(df: DataFrame, horizons: int = HORIZONS) -> DataFrame:
    """df's rows by horizon h, with y, the log return over the next h bars; bars without a later close have none."""
    s = Window.partitionBy("symbol").orderBy("t")
    ahead = [F.when((F.col("c") > 0) & (F.lead("c", h).over(s) > 0), F.ln(F.lead("c", h).over(s) / F.col("c"))) for h in range(1, horizons + 1)]
    df = df.select(*df.columns, F.array(*ahead).alias("ahead"))
    return df.select(*[c for c in df.columns if c != "ahead"], F.posexplode("ahead").alias("h", "y")).withColumn("h", F.col("h") + 1).where("y is not null")


def origins(rows: DataFrame, first: int, step: int, horizons: int = HORIZONS) -> DataFrame:
    """Every step-th bar from the index ``first`` (from 0) on that still has all its outcomes."""
    i = F.col("n") - 1
    return rows.where((i >= first) & ((i - first) % step == 0) & (i < F.col("last") - horizons))


def errors(predicted: dict[str, F.Column]) -> list:
    """mae, rmse, and hits among predictions with a sign, for each named prediction of y."""
    out = []
    for name, p in predicted.items():
        signed = F.when(p != 0, ((F.col("y") > 0) == (p > 0)).cast("double"))
        out += [F.avg(F.abs(F.col("y") - p)).alias(f"{name}_mae"), F.sqrt(F.avg((F.col("y") - p) ** 2)).alias(f"{name}_rmse"), F.avg(signed).alias(f"{name}_hits"), F.count(signed).alias(f"{name}_signed")]
    return out


def walk_forward_baselines(bars: DataFrame, first: int = 80, step: int = 10) -> DataFrame:
    """symbol, h, n and the errors of no move and of drift."""
    rows = origins(outcomes(drifts(bars)), first, step)
    return rows.groupBy("symbol", "h").agg(F.count("*").alias("n"), *errors({"zero": F.lit(0.0), "drift": F.col("drift") * F.col("h")}))


def gated(bars: DataFrame, minutes: int, parent: int) -> DataFrame:
    """drifts() with the regime of the last three complete parents known at the bar's close, and the drift that it lets through (step)."""
    s = Window.partitionBy("symbol").orderBy("t")
    older, mid, last = F.lag("c", 2).over(s), F.lag("c").over(s), F.col("c")
    regime = F.when((last < mid) & (mid < older), "bearish").when((last > mid) & (mid > older), "bullish").otherwise("neutral")
    parents = resample(bars, minutes, parent).select("symbol", (F.col("t") + 60 * parent).alias("parent_known"), regime.alias("regime"))
    df = asof_attach(drifts(bars).withColumn("known", F.col("t") + 60 * minutes), parents, "known", "parent_known", ["regime"])
    df = df.drop("known").withColumn("regime", F.coalesce("regime", F.lit("neutral")))
    d = F.col("drift")
    return df.withColumn("step", F.when(d.isNull(), None).when(F.col("regime") == "bearish", F.least(d, F.lit(0.0))).when(F.col("regime") == "bullish", F.greatest(d, F.lit(0.0))).otherwise(d))


def walk_forward_gated(bars: DataFrame, minutes: int, parent: int, first: int = 199, step: int = 20) -> DataFrame:
    """symbol, h, n and the errors of no move, of drift and of gated drift."""
    rows = origins(outcomes(gated(bars, minutes, parent)), first, step)
    named = {"zero": F.lit(0.0), "drift": F.col("drift") * F.col("h"), "gated": F.col("step") * F.col("h")}
    return rows.groupBy("symbol", "h").agg(F.count("*").alias("n"), *errors(named))


def signed_probabilities(bars: DataFrame, first: int = 79, step: int = 15) -> DataFrame:
    """For each origin and horizon: prior (outcomes known by then), p_up among those of the drift's sign (all, for none), and q10, q90 of
    drift plus the prior residuals; null below the least number."""
    rows = origins(outcomes(drifts(bars)), first, step).withColumn("p", F.coalesce("drift", F.lit(0.0)) * F.col("h"))
    both = rows.select("symbol", "t", "h", "y", "p", F.inline(F.array(F.struct((F.col("n") + F.col("h")).alias("at"), F.lit(0).alias("asks")), F.struct(F.col("n").alias("at"), F.lit(1).alias("asks")))))
    w = Window.partitionBy("symbol", "h").orderBy("at", "asks", "t").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("asks") == 0
    count = lambda test: F.coalesce(F.sum(F.when(known & test, 1).otherwise(0)).over(w), F.lit(0))
    up, p = F.col("y") > 0, F.col("p")
    sums = {"prior": F.lit(True), "pos": p > 0, "pos_up": (p > 0) & up, "neg": p < 0, "neg_up": (p < 0) & up, "all_up": up}
    both = both.select("*", *[count(v).alias(k) for k, v in sums.items()], F.percentile(F.when(known, F.col("y") - p), F.array(F.lit(0.1), F.lit(0.9))).over(w).alias("q")).where("asks = 1")
    side = lambda a, b, c: F.when(p > 0, F.col(a)).when(p < 0, F.col(b)).otherwise(F.col(c))
    n, hits = side("pos", "neg", "prior"), side("pos_up", "neg_up", "all_up")
    wide = F.col("prior") >= LEAST
    return both.select("symbol", "t", "h", "y", "prior", F.when(n >= LEAST, hits / n).alias("p_up"), F.when(wide, p + F.col("q")[0]).alias("q10"), F.when(wide, p + F.col("q")[1]).alias("q90"))


def probability_scores(bars: DataFrame, first: int = 79, step: int = 15) -> DataFrame:
    """By symbol and horizon: Brier score, calibration error over five bins, coverage and pinball losses of the intervals; null below the least numbers."""
    rows = signed_probabilities(bars, first, step).withColumn("up", (F.col("y") > 0).cast("double"))
    bins = rows.where("p_up is not null").withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.col("p_up") * BINS)))
    bins = bins.groupBy("symbol", "h", "bin").agg(F.count("*").alias("k"), F.avg("p_up").alias("mp"), F.avg("up").alias("mu"))
    error = bins.groupBy("symbol", "h").agg((F.sum(F.col("k") * F.abs(F.col("mp") - F.col("mu"))) / F.sum("k")).alias("ece"))
    loss = lambda q, c: F.avg(F.greatest(q * (F.col("y") - F.col(c)), (q - 1) * (F.col("y") - F.col(c))))
    out = rows.groupBy("symbol", "h").agg(
        F.count("p_up").alias("n_p"), F.count("q10").alias("n_q"), F.avg(F.when(F.col("p_up").isNotNull(), (F.col("p_up") - F.col("up")) ** 2)).alias("brier"),
        F.avg(F.when(F.col("q10").isNotNull(), F.col("y").between(F.col("q10"), F.col("q90")).cast("double"))).alias("coverage"), loss(0.1, "q10").alias("pinball10"), loss(0.9, "q90").alias("pinball90"),
    )
    out = out.join(error, ["symbol", "h"], "left")
    enough = lambda c, n, least: F.when(F.col(n) >= least, F.col(c)).alias(c)
    return out.select("symbol", "h", "n_p", "n_q", enough("brier", "n_p", LEAST), enough("ece", "n_p", LEAST_CALIBRATION), *[enough(c, "n_q", LEAST) for c in ("coverage", "pinball10", "pinball90")])
