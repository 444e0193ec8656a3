"""The state of a timeframe at every bar, and the regime of lower timeframes inside their parents, as of each base bar's close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_attach
from .recurrences import with_recurrences
from .resample import resample

#: Bars on each side of a pivot, returns of a volatility, its ratios to the mean move, the weights of a regime's parts, a parent's pull and the hysteresis.
SIDE, WIDE, EXPANDED, COMPRESSED = 3, 24, 1.5, 0.75
WEIGHTS, PULL, HYSTERESIS = {"ema_order": 0.30, "swing": 0.25, "momentum": 0.15, "volume": 0.10, "parent": 0.20}, 0.7, 0.35


def confirmed_pivots(bars: DataFrame, side: int = SIDE) -> DataFrame:
    """symbol, t, known_t, kind, price: highs above, lows below all ``side`` bars before and after; known at the last of these."""
    s = Window.partitionBy("symbol").orderBy("t")
    around = lambda f, c: (f(c).over(s.rowsBetween(-side, -1)), f(c).over(s.rowsBetween(1, side)))
    (ha, hb), (la, lb) = around(F.max, "h"), around(F.min, "l")
    row = lambda kind, test, price: F.when(test, F.struct(F.lit(kind).alias("kind"), F.col(price).alias("price")))
    found = F.array_compact(F.array(row("high", (F.col("h") > ha) & (F.col("h") > hb), "h"), row("low", (F.col("l") < la) & (F.col("l") < lb), "l")))
    rows = bars.select("symbol", "t", F.lead("t", side).over(s).alias("known_t"), F.count("*").over(s.rowsBetween(-side, side)).alias("n"), found.alias("found"))
    return rows.where(F.col("n") == 2 * side + 1).select("symbol", "t", "known_t", F.inline("found"))


def with_swings(bars: DataFrame, side: int = SIDE) -> DataFrame:
    """bars with swing: the last two highs and lows known at the bar."""
    pivots = confirmed_pivots(bars, side)
    s = Window.partitionBy("symbol").orderBy("t")
    for kind, at in (("high", "hi"), ("low", "lo")):
        two = pivots.where(F.col("kind") == kind).select("symbol", "known_t", F.col("price").alias(f"{at}1"), F.lag("price").over(s).alias(f"{at}2"))
        bars = asof_attach(bars, two, "t", "known_t", [f"{at}1", f"{at}2"])
    higher, lower = F.col("hi1") > F.col("hi2"), F.col("lo1") > F.col("lo2")
    swing = F.when(F.col("hi2").isNull() | F.col("lo2").isNull(), "insufficient").when(higher & lower, "HH_HL").when(~higher & ~lower, "LH_LL").otherwise("mixed")
    return bars.withColumn("swing", swing).drop("hi1", "hi2", "lo1", "lo2")


def timeframe_states(bars: DataFrame) -> DataFrame:
    """symbol, t, regime, swing, volatility: votes of the averages' order and of the swing; two votes more decide."""
    df = with_swings(with_recurrences(bars))
    s = Window.partitionBy("symbol").orderBy("t")
    df = df.withColumn("x", F.col("c") / F.nullif(F.lag("c").over(s), F.lit(0.0)) - 1)
    c, e20, e50, e200, w = *(F.col(x) for x in ("c", "ema20", "ema50", "ema200")), s.rowsBetween(1 - WIDE, 0)
    vote = lambda test, n: F.when(test, n).otherwise(0)
    bull = vote((c > e20) & (e20 > e50), 2) + vote((e20 > e50) & (e50 > e200), 1) + vote(F.col("swing") == "HH_HL", 2)
    bear = vote((c < e20) & (e20 < e50), 2) + vote((e20 < e50) & (e50 < e200), 1) + vote(F.col("swing") == "LH_LL", 2)
    vol, mean = F.stddev_pop("x").over(w), F.avg(F.abs("x")).over(w)
    volatility = F.when(F.count("x").over(w) < WIDE, "unknown").when(vol > mean * EXPANDED, "expanded").when(vol < mean * COMPRESSED, "compressed").otherwise("normal")
    return df.select("symbol", "t", F.when(bull >= bear + 2, "bullish").when(bear >= bull + 2, "bearish").otherwise("neutral").alias("regime"), "swing", volatility.alias("volatility"))


def _decided(c: Column) -> Column:
    return F.when(c.isin("bullish", "bearish"), c)


def states_in_context(bars: DataFrame, minutes: int, parents: dict[str, int]) -> DataFrame:
    """Every base bar's state inside the last complete parents (minutes by label, longest first): the nearest decided parent turns a neutral
    child into a transition and marks one that disagrees; parent_regime is the longest decided one."""
    out = timeframe_states(bars).withColumn("known", F.col("t") + 60 * minutes)
    for label, parent in parents.items():
        own = timeframe_states(resample(bars, minutes, parent)).select("symbol", (F.col("t") + 60 * parent).alias("known_"), F.col("regime").alias(f"own_{label}"))
        out = asof_attach(out, own, "known", "known_", [f"own_{label}"])
    above = [_decided(F.col(f"own_{label}")) for label in parents]
    nearest, longest = F.coalesce(*reversed(above), F.lit(None)), F.coalesce(*above, F.lit("unknown"))
    inherited = F.when((F.col("regime") == "neutral") & nearest.isNotNull(), F.when(nearest == "bullish", "transition_up").otherwise("transition_down")).otherwise(F.col("regime"))
    against = nearest.isNotNull() & ~F.col("regime").isin("neutral") & (F.col("regime") != nearest)
    out = out.withColumn("in_context", inherited).withColumn("countertrend", F.coalesce(against, F.lit(False))).withColumn("parent_regime", longest)
    relief = ((F.col("parent_regime") == "bullish") & F.col("in_context").isin("bearish", "transition_down")) | ((F.col("parent_regime") == "bearish") & F.col("in_context").isin("bullish", "transition_up"))
    reading = F.when(relief, "relief").when(F.col("parent_regime") != "unknown", "inside_parent").otherwise("")
    return out.select("symbol", "t", "regime", "swing", "volatility", "in_context", "countertrend", "parent_regime", reading.alias("reading"))


def regime_scores(df: DataFrame) -> DataFrame:
    """df (ema_order, swing, momentum, volume from -1 to 1; parent_regime, prior) with raw and state: a weighted score with hysteresis.

    Between the bounds a decided prior state becomes a transition; a state against its decided parent is reported as a transition too.
    """
    pull = F.when(F.col("parent_regime") == "bullish", PULL).when(F.col("parent_regime") == "bearish", -PULL).otherwise(0.0)
    raw = sum((F.lit(w) * F.col(k) for k, w in WEIGHTS.items() if k != "parent"), F.lit(0.0)) + WEIGHTS["parent"] * pull
    df = df.withColumn("raw", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))
    state = F.when(F.col("raw") >= HYSTERESIS, "bullish").when(F.col("raw") <= -HYSTERESIS, "bearish").when(F.col("prior") == "bullish", "transition_down").when(F.col("prior") == "bearish", "transition_up").otherwise("neutral")
    df = df.withColumn("state", state)
    against = F.col("parent_regime").isin("bullish", "bearish") & F.col("state").isin("bullish", "bearish") & (F.col("state") != F.col("parent_regime"))
    return df.withColumn("state", F.when(against, F.when(F.col("state") == "bullish", "transition_up").otherwise("transition_down")).otherwise(F.col("state")))


def parent_child_reading(parent: Column, child: Column) -> Column:
    return F.when(parent.isin("bearish", "bullish") & (child != parent), F.concat(F.lit("child_"), child, F.lit("_inside_parent_"), parent)).otherwise(F.concat(F.lit("aligned_"), parent))


def accumulation(bars: DataFrame, box: int = 12) -> DataFrame:
    """symbol, t, upper_half, volume_balance, decision of every bar with a whole box: accumulation on rising lows, closes in the upper half and no more falling volume; distribution the other way round.

    Lows and highs are the last up to three known at the bar, the newest against the oldest.
    """
    s = Window.partitionBy("symbol").orderBy("t")
    w = s.rowsBetween(1 - box, 0)
    top, bottom = F.max("h").over(w), F.min("l").over(w)
    df = bars.withColumns({"closes": F.collect_list("c").over(w), "top": top, "bottom": bottom, "volume_balance": F.sum(F.when(F.col("c") >= F.col("o"), F.col("v")).otherwise(-F.col("v"))).over(w)})
    df = df.where(F.size("closes") == box)
    pivots = confirmed_pivots(bars)
    for kind in ("low", "high"):
        own = pivots.where(F.col("kind") == kind)
        oldest = F.coalesce(F.lag("price", 2).over(s), F.lag("price", 1).over(s))
        df = asof_attach(df, own.select("symbol", "known_t", F.col("price").alias(f"{kind}_new"), oldest.alias(f"{kind}_old")), "t", "known_t", [f"{kind}_new", f"{kind}_old"])
    df = df.withColumn("upper_half", F.size(F.filter("closes", lambda c: c >= (F.col("top") + F.col("bottom")) / 2)).cast("long"))
    up = (F.col("low_new") > F.col("low_old")) & (F.col("upper_half") * 2 >= box) & (F.col("volume_balance") >= 0)
    down = (F.col("high_new") < F.col("high_old")) & (F.col("upper_half") * 2 <= box) & (F.col("volume_balance") <= 0)
    decision = F.when(F.col("top") <= F.col("bottom"), "none").when(up, "accumulation").when(down, "distribution").otherwise("none")
    return df.select("symbol", "t", "upper_half", "volume_balance", decision.alias("decision"))
