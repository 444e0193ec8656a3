"""Price rules against bars and pivots of their own timeframe, and what comes of a level after its first cross."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical


def _fires() -> Column:
    kind, price = F.col("kind"), F.col("price")
    bar = F.when(kind == "close_above", F.col("c") > price).when(kind == "close_below", F.col("c") < price).when(kind == "high_above", F.col("h") > price).when(kind == "low_below", F.col("l") < price)
    return F.coalesce(bar.when(kind == "range_expansion", F.col("h") - F.col("l") >= price), F.lit(False))


def firings(rules: DataFrame, bars: DataFrame, pivots: DataFrame) -> DataFrame:
    """symbol, id, fires, first_t for rules (symbol, id, kind, price, timeframe): the bars (with timeframe) and pivots (known_t, pivot_kind, pivot_price) at which a rule
    is met. Rules of a symbol are few and bars many; both meet on (symbol, timeframe), and firings are counted before they are shuffled."""
    on_bars = rules.join(bars.select("symbol", "timeframe", "t", "h", "l", "c"), ["symbol", "timeframe"]).where(_fires()).select("symbol", "id", "t")
    high = (F.col("kind") == "pivot_high_above") & (F.col("pivot_kind") == "high") & (F.col("pivot_price") > F.col("price"))
    low = (F.col("kind") == "pivot_low_below") & (F.col("pivot_kind") == "low") & (F.col("pivot_price") < F.col("price"))
    on_pivots = rules.join(pivots.select("symbol", F.col("known_t").alias("t"), "pivot_kind", "pivot_price"), "symbol").where(high | low).select("symbol", "id", "t")
    met = on_bars.unionByName(on_pivots).groupBy("symbol", "id").agg(F.count("*").alias("fires"), F.min("t").alias("first_t"))
    return rules.select("symbol", "id", "kind").join(met, ["symbol", "id"], "left").select("symbol", "id", "kind", F.coalesce("fires", F.lit(0).cast("long")).alias("fires"), "first_t")


def fingerprints(rules: DataFrame) -> DataFrame:
    """rules with fingerprint, the SHA-256 of the rule's canonical JSON."""
    rows = rules.withColumn("_rule", F.struct("description", "id", "kind", "price", "timeframe"))
    return rows.withColumn("fingerprint", F.sha2(canonical(F.col("_rule"), rows.schema["_rule"].dataType), 256)).drop("_rule")


def regime_relation(direction: Column, parent: Column) -> Column:
    """Whether a hypothesis goes with its parent's regime."""
    of = F.when(parent.isin("bullish", "transition_up"), "bull").when(parent.isin("bearish", "transition_down"), "bear")
    return F.when(parent == "neutral", "mixed").when(of.isNull(), "unknown").when(direction == "neutral", "mixed").when(direction == of, "aligned").otherwise("countertrend")


def status(kind: Column, evidence: Column, counter: Column, counted: tuple[str, ...]) -> Column:
    """active from two pieces of evidence on, if they outnumber those against; kinds in ``counted`` stay candidates."""
    return F.when(kind.isin(*counted), "candidate").when((evidence >= 2) & (evidence > counter), "active").otherwise("candidate")


def level_resolutions(bars: DataFrame, levels: DataFrame, acceptance: int = 2) -> DataFrame:
    """symbol, level, side, cross_t, outcome: failed_breakout where the closes beyond the first cross are too few, successful_reclaim where an accepted breakdown is
    followed by enough closes above in a row, else null. levels: symbol, level, one a symbol; levels that are never crossed have no row."""
    s = Window.partitionBy("symbol").orderBy("t")
    c, level = F.col("c"), F.col("level")
    rows = bars.select("symbol", "t", "c").join(levels.select("symbol", "level"), "symbol").withColumn("n", F.row_number().over(s)).withColumn("before", F.lag("c").over(s))
    side = F.when((F.col("before") <= level) & (level < c), "above").when((F.col("before") >= level) & (level > c), "below")
    first = F.min(F.when(side.isNotNull(), F.struct("n", "t", side.alias("side")))).over(Window.partitionBy("symbol"))
    rows = rows.withColumn("first", first).where("n >= first.n")
    beyond = F.when(F.col("first.side") == "above", c > level).otherwise(c < level)
    rows = rows.withColumn("j", F.min(F.when(~beyond, F.col("n"))).over(Window.partitionBy("symbol")))
    recent = s.rowsBetween(1 - acceptance, 0)
    held = (F.count("*").over(recent) == acceptance) & (F.min("c").over(recent) > level) & (F.col("n") - (acceptance - 1) >= F.col("j"))
    met = rows.withColumn("held", held).groupBy("symbol", "level", F.col("first.side").alias("side"), F.col("first.t").alias("cross_t")).agg((F.max("j") - F.max("first.n")).alias("run"), F.max("held").alias("held"))
    outcome = F.when(F.col("run") < acceptance, "failed_breakout").when((F.col("side") == "below") & F.col("held"), "successful_reclaim")
    return met.select("symbol", "level", "side", "cross_t", outcome.alias("outcome"))
