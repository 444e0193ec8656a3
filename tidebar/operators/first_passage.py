"""The first bar from some time on whose value lies beyond a level, for many times and levels of long series.

A series' bars are leaves of a tree over time: a group holds the bars of ``span`` seconds, or FAN neighbouring groups of the level below, with the maxima and minima of each. A search looks into the rest of
its own group, goes up while that holds no value beyond its level, and then down into the first group that does. Each step meets one group, by an equal
join on it; no search meets all bars, and no group holds more than FAN entries (a group of bars as many as its span has).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import durable

#: Groups of a group, and levels of groups, the last of which has one group for a series: with a day's bars in a leaf one entry for 64 ** 3 days.
FAN, LEVELS, SPAN = 64, 4, 86_400

#: By kind: whether a maximum or a minimum tells, of which value, and whether the level itself counts.
KINDS = {
    "close_above": ("max", "c", False),
    "close_below": ("min", "c", False),
    "close_at_least": ("max", "c", True),
    "close_at_most": ("min", "c", True),
    "high_above": ("max", "h", False),
    "low_below": ("min", "l", False),
    "pair_above": ("max", "pair", False),
    "range_expansion": ("max", "range", True),
}


def _beyond(node: Column, kind: Column, price: Column) -> Column:
    test = F.lit(False)
    for name, (end, value, equal) in KINDS.items():
        v = node[f"{end}_{value}"]
        met = {("max", False): v > price, ("max", True): v >= price, ("min", False): v < price, ("min", True): v <= price}[end, equal]
        test = F.when(kind == name, met).otherwise(test)
    return F.coalesce(test, F.lit(False))


def _ends() -> list[str]:
    return sorted({f"{end}_{value}" for end, value, _ in KINDS.values()})


def trees(bars: DataFrame, span: int = SPAN) -> list[DataFrame]:
    """Groups by level, of bars (symbol, t, h, l, c): symbol, grp, nodes in order of time. ``pair`` is the lesser of a close and the one before."""
    s = Window.partitionBy("symbol", F.floor(F.col("t") / span)).orderBy("t")
    # the close before a group's first bar is that of the group before
    last = bars.groupBy("symbol", F.floor(F.col("t") / span).alias("g")).agg(F.max_by("c", "t").alias("last"))
    last = last.select("symbol", F.col("g").alias("g_"), F.lag("last").over(Window.partitionBy("symbol").orderBy("g")).alias("earlier"))
    df = bars.withColumn("g_", F.floor(F.col("t") / span)).join(last, ["symbol", "g_"])
    pair = F.least("c", F.coalesce(F.lag("c").over(s), F.col("earlier")))
    value = {"c": F.col("c"), "h": F.col("h"), "l": F.col("l"), "pair": F.when(F.coalesce(F.lag("c").over(s), F.col("earlier")).isNotNull(), pair), "range": F.col("h") - F.col("l")}
    df = df.select("symbol", F.col("t").alias("key"), *[value[e.split("_")[1]].alias(e) for e in _ends()])
    out, width = [], span
    for k in range(LEVELS):
        group = F.floor(F.col("key") / width).cast("long") if k < LEVELS - 1 else F.lit(0).cast("long")
        groups = df.groupBy("symbol", group.alias("grp")).agg(F.array_sort(F.collect_list(F.struct("key", *_ends()))).alias("nodes"), *[getattr(F, e.split("_")[0])(e).alias(e) for e in _ends()])
        groups = durable(groups)
        out.append(groups.select("symbol", "grp", "nodes"))
        df, width = groups.select("symbol", F.col("grp").alias("key"), *_ends()), FAN
    return out


def first_passages(bars: DataFrame, searches: DataFrame, span: int = SPAN) -> DataFrame:
    return passages(trees(bars, span), searches, span)


def passages(levels: list[DataFrame], searches: DataFrame, span: int = SPAN) -> DataFrame:
    """searches (symbol, from_t, kind, price and more columns of other names) with hit_t, the first bar's time from from_t on that lies beyond the price in the way of its kind (KINDS), or null."""
    own = F.struct(*searches.columns)
    df = searches.select(own.alias("row"), "symbol", "kind", "price", F.col("from_t").cast("long").alias("start"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("key"))
    group_of = lambda k: F.lit(0).cast("long") if k == LEVELS - 1 else F.floor(F.col("start") / (FAN if k else span)).cast("long")

    def looked(df: DataFrame, k: int, group: Column, least: Column) -> DataFrame:
        """df with ``found``: the first node of its group on level k from ``least`` on that is beyond."""
        nodes = levels[k].select(F.col("symbol").alias("_symbol"), F.col("grp").alias("_grp"), "nodes")
        joined = df.withColumns({"_group": group, "_least": least}).join(nodes, (F.col("symbol") == F.col("_symbol")) & (F.col("_group") == F.col("_grp")), "left")
        first = F.get(F.filter("nodes", lambda n: (n["key"] >= F.col("_least")) & _beyond(n, F.col("kind"), F.col("price"))), F.lit(0))["key"]
        return joined.withColumn("found", first).drop("_symbol", "_grp", "nodes", "_least")

    for k in range(LEVELS):
        open_ = F.col("level").isNull()
        df = looked(df, k, F.when(open_, group_of(k)), F.col("start"))
        hit = open_ & F.col("found").isNotNull()
        # what is left begins with the next group, a level higher
        df = df.withColumns({"level": F.when(hit, k).otherwise(F.col("level")), "key": F.when(hit, F.col("found")).otherwise(F.col("key")), "start": F.when(open_ & ~hit, F.col("_group") + 1).otherwise(F.col("start"))}).drop("_group", "found")
    for k in range(LEVELS - 2, -1, -1):
        above = F.col("level") > k
        df = looked(df, k, F.when(above, F.col("key")), F.lit(-(2**62)))
        df = df.withColumns({"key": F.when(above, F.col("found")).otherwise(F.col("key")), "level": F.when(above, k).otherwise(F.col("level"))}).drop("_group", "found")
    return df.select("row.*", F.col("key").alias("hit_t"))


def level_outcomes(bars: DataFrame, levels: DataFrame, span: int = SPAN, acceptance: int = 2) -> DataFrame:
    """levels (symbol, id, level, from_t) with side, cross_t, run and outcome: what came of the first cross among the bars from from_t on.

    failed_breakout if the closes beyond it end before ``acceptance`` of them; successful_reclaim if a breakdown was accepted and two closes in a row above the level followed.
    A level that is not crossed has nulls.
    """
    s = Window.partitionBy("symbol").orderBy("t")
    numbered = durable(bars.select("symbol", F.col("t").alias("at"), F.row_number().over(s).alias("n"), F.lead("t").over(s).alias("after"), "c"))
    tree = trees(bars, span)

    def search(df: DataFrame, *wanted: tuple[str, Column, str], price: Column | None = None) -> DataFrame:
        """df with a time for each (kind, start, name); a null start is no search. Written, as plans of several searches would grow with each other."""
        asked = F.array(*[F.struct(F.lit(kind).alias("kind"), start.alias("from_t"), F.lit(name).alias("name")) for kind, start, name in wanted])
        rows = df.select("symbol", "id", F.inline(asked), (F.col("level") if price is None else price).alias("price")).where("from_t is not null")
        found = passages(tree, rows, span).groupBy("symbol", "id").agg(*[F.max(F.when(F.col("name") == name, F.col("hit_t"))).alias(name) for _, _, name in wanted])
        return durable(df.join(found, ["symbol", "id"], "left"))

    df = search(levels, ("close_at_least", F.col("from_t"), "first_t"), price=F.lit(float("-inf")))
    df = df.join(numbered.select("symbol", F.col("at").alias("first_t"), F.col("c").alias("first_c")), ["symbol", "first_t"], "left")
    # from a first close below, the first close above is the cross; from one at the level whichever comes first
    beside = F.col("first_c") - F.col("level")
    df = search(df, ("close_above", F.when(beside <= 0, F.col("first_t")), "up_t"), ("close_below", F.when(beside >= 0, F.col("first_t")), "down_t"))
    cross = F.least("up_t", "down_t")
    df = df.withColumns({"cross_t": cross, "side": F.when(cross == F.col("up_t"), "above").when(cross == F.col("down_t"), "below")})
    df = search(df, ("close_at_most", F.when(F.col("side") == "above", F.col("cross_t")), "a_t"), ("close_at_least", F.when(F.col("side") == "below", F.col("cross_t")), "b_t"))
    df = df.withColumn("end_t", F.coalesce("a_t", "b_t"))
    total = numbered.groupBy("symbol").agg(F.max("n").alias("total"))
    df = df.join(numbered.select("symbol", F.col("at").alias("cross_t"), F.col("n").alias("n_cross")), ["symbol", "cross_t"], "left")
    df = df.join(numbered.select("symbol", F.col("at").alias("end_t"), F.col("n").alias("n_end"), F.col("after").alias("then_t")), ["symbol", "end_t"], "left").join(total, "symbol", "left")
    df = search(df, ("pair_above", F.when(F.col("side") == "below", F.col("then_t")), "back_t"))
    run = F.coalesce(F.col("n_end"), F.col("total") + 1) - F.col("n_cross")
    outcome = F.when((run < acceptance) & F.col("end_t").isNotNull(), "failed_breakout").when((F.col("side") == "below") & (run >= acceptance) & F.col("back_t").isNotNull(), "successful_reclaim")
    kept = [c for c in levels.columns if c != "from_t"]
    return df.select(*kept, "from_t", "side", "cross_t", run.cast("long").alias("run"), "end_t", outcome.alias("outcome"))
