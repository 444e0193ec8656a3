"""Any predictor, walked forward over folds: ranges of a series to learn from and to be judged on.

Folds of neighbouring ranges are one group, and get the rows that any of them needs once; the predictor is called for each fold with slices of these. Rows and groups meet by an equal join on
cells of the series' numbering, so a row is copied into as many groups as reach its cell, and not into every fold.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bars of a cell; folds that are judged from the same cell on are one group.
CELL = 2048


def rolling_folds(rows: DataFrame, first: int, step: int, lookback: int, gap: int, ahead: int = 1) -> DataFrame:
    """symbol, fold, train_from, train_to, test_from, test_to (numbers of rows, both ends inside): every step-th row from the first-th on is judged with ``ahead`` - 1 rows after it, and learnt from the
    ``lookback`` rows before it, but the last ``gap`` - 1 of them, whose outcomes are not known yet."""
    last = rows.groupBy("symbol").agg(F.max("n").alias("last"))
    at = F.explode(F.when(F.col("last") >= first, F.sequence(F.lit(first).cast("long"), F.col("last").cast("long"), F.lit(step).cast("long")))).alias("at")
    folds = last.select("symbol", at)
    return folds.select("symbol", ((F.col("at") - first) / step).cast("long").alias("fold"), F.greatest(F.col("at") - lookback, F.lit(1)).alias("train_from"), (F.col("at") - gap).alias("train_to"), F.col("at").alias("test_from"), (F.col("at") + ahead - 1).alias("test_to"))


def walk_folds(rows: DataFrame, folds: DataFrame, predict: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, cell: int = CELL) -> DataFrame:
    """symbol, fold and what ``predict`` gives of each fold: it gets the rows (symbol, n and more) to learn from and those to be judged, in order of n, and returns a frame of ``schema``."""
    of = lambda n: F.floor(n / cell).cast("long")
    keyed = folds.withColumn("group", of(F.col("test_from")))
    reach = keyed.groupBy("symbol", "group").agg(F.min("train_from").alias("a"), F.max("test_to").alias("b"))
    wanted = reach.select("symbol", "group", "a", "b", F.explode(F.sequence(of(F.col("a")), of(F.col("b")))).alias("cell"))
    dealt = rows.withColumn("cell", of(F.col("n"))).join(wanted, ["symbol", "cell"]).where("n between a and b").drop("a", "b", "cell")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(there):
            there = there.drop(columns="group").sort_values("n", ignore_index=True)
            n = there["n"]
            cut = lambda a, b: there.iloc[n.searchsorted(a) : n.searchsorted(b, side="right")]
            for f in asked.sort_values("fold").itertuples(index=False):
                found = predict(cut(f.train_from, f.train_to), cut(f.test_from, f.test_to))
                if len(found):
                    out.append(found.assign(symbol=f.series, fold=f.fold)[["symbol", "fold", *names]])
        return pd.concat(out) if out else pd.DataFrame([], columns=["symbol", "fold", *names])

    # under names of their own, as the groups come from the folds, too
    keyed = keyed.select(*[F.col(c).alias(n) for c, n in (("symbol", "series"), ("group", "part"), ("fold", "fold"), ("train_from", "train_from"), ("train_to", "train_to"), ("test_from", "test_from"), ("test_to", "test_to"))])
    return keyed.groupBy("series", "part").cogroup(dealt.groupBy("symbol", "group")).applyInPandas(run, f"symbol string, fold long, {schema}")
