"""State machines over long series, in blocks of time that run side by side.

A machine that forgets (a zigzag after its next reversal) can begin anywhere and soon agrees with the run that began at the start. So all blocks first run from an empty state.
Each block then learns in which state the block before it ended; those that had begun in another one run again, from the right
one, until none is left. The result is the fold's, whatever the machine; only the number of rounds depends on how fast it forgets, and a round works on blocks that changed alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import durable

#: (rows of a block in order of time, state or None) -> (rows that it gives, state after it); states are texts.
Run = Callable[[pd.DataFrame, str | None], tuple[pd.DataFrame, str]]


def fold_blocks(rows: DataFrame, run: Run, schema: str) -> DataFrame:
    """What ``run`` gives over every symbol's rows (symbol, _block, t and more), as if each series were one block."""
    keys, rows = ["symbol", "_block"], durable(rows)

    def end(pdf: pd.DataFrame, assumed: pd.DataFrame) -> pd.DataFrame:
        begun = assumed["assumed"].iloc[0]
        return assumed[["symbol", "_block", "assumed"]].assign(ended=run(pdf.sort_values("t", kind="stable"), begun)[1])

    def ended(assumed: DataFrame) -> DataFrame:
        wanted = rows.join(assumed.select(*keys), keys, "left_semi")
        return durable(wanted.groupBy(*keys).cogroup(assumed.groupBy(*keys)).applyInPandas(end, "symbol string, _block long, assumed string, ended string"))

    known = ended(durable(rows.select(*keys).distinct().withColumn("assumed", F.lit(None).cast("string"))))
    while True:
        before = F.lag("ended").over(Window.partitionBy("symbol").orderBy("_block"))
        stale = durable(known.withColumn("right", before).where(~F.col("right").eqNullSafe(F.col("assumed"))).select(*keys, F.col("right").alias("assumed")))
        if stale.isEmpty():
            break
        known = durable(known.join(stale.select(*keys), keys, "left_anti").unionByName(ended(stale)))

    def give(pdf: pd.DataFrame, begun: pd.DataFrame) -> pd.DataFrame:
        return run(pdf.sort_values("t", kind="stable"), begun["assumed"].iloc[0])[0]

    return rows.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInPandas(give, schema)


def sorted_pass(rows: DataFrame, keys: list[str], order: list[str], machine: Callable[[], Callable[[tuple], list[tuple]]], schema: str) -> DataFrame:
    """Every group's rows in order through a machine of its own: ``machine()`` gives a function from a row (a named tuple) to rows of ``schema``.

    A group is neither collected nor copied: a task holds its machine and one batch of rows, however long the group is.
    """
    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = [part.split()[0] for part in schema.replace("\n", " ").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = step = None
        for pdf in batches:
            out = []
            for r in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
                own = tuple(getattr(r, k) for k in keys)
                if step is None or own != key:
                    key, step = own, machine()
                out += step(r)
            yield pd.DataFrame(out, columns=names, dtype=object)

    return sorted_rows.mapInPandas(run, schema)
