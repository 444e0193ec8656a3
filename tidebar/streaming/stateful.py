"""Indicators, zigzag pivots and zones of a stream of closed bars, with the state of each symbol kept between micro-batches.

A symbol's averages are a handful of numbers, its zigzag three, its zones one row each; what a micro-batch does not touch is not written again. Retired zones
leave the state at once. A symbol without bars for ``idle`` seconds of event time is evicted whole; its next bar begins a new series.

Bars must come in order of time within a symbol, in any order within a micro-batch. One that is not later than the symbol's last bar is not applied, as values that were given out
depend on that; it is given back as a row of kind ``late``. For the state's store the session needs RocksDB: ``with_store``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.recurrences import Indicators
from ..operators.zones import Policy, Zigzag, Zone, ZoneBook, dump_zone, load_zone

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
INPUT = {"symbol": "string", "t": "long", "o": "double", "h": "double", "l": "double", "c": "double", "v": "double", "zone_id": "string", "lower": "double", "upper": "double", "role": "string", "base": "double"}
_EVENT = {"zone_id": "string", "from_state": "string", "state": "string", "causes": "string", "tests": "int", "strength": "double", "outcome": "string", "status": "string"}


def with_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def output_columns() -> dict[str, str]:
    return {"symbol": "string", "kind": "string", "t": "long", "c": "double"} | {n: "double" for n in Indicators().names} | {"pivot_t": "long", "price": "double", "pivot_kind": "string"} | _EVENT


class BarMachine(StatefulProcessor):
    """Rows of kind bar (with indicators), pivot, zone (an event) and late."""

    def __init__(self, multiple: float = 2.0, policy: Policy = Policy(), idle: int | None = None):
        self.multiple, self.policy, self.idle = multiple, policy, idle

    def init(self, handle) -> None:
        self.handle = handle
        # rows so far, last time and close, the averages, the zigzag
        self.series = handle.getValueState("series", "n long, t long, c double, averages array<double>, zigzag string")
        self.zones = handle.getMapState("zones", "zone_id string", "zone string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf = pdf.assign(bar=pdf["zone_id"].isna()).sort_values(["t", "bar"], kind="stable")
        kind, (symbol,) = Indicators(), key
        n, last_t, last_c, state, turns = self.series.get() if self.series.exists() else (0, None, None, kind.empty(), None)
        zigzag, book = Zigzag(turns), ZoneBook(self.policy)
        for _, (text,) in self.zones.iterator():
            known_t, zone = load_zone(text)
            book.restore(zone) if known_t is None else book.declare(known_t, zone)
        book.changed.clear()
        waiting = {zone_id: t for t, zone_id in book.pending}

        state, out = list(state), []
        for r in pdf.itertuples(index=False):
            if not r.bar:
                if r.zone_id not in book.zones:
                    waiting[r.zone_id] = int(r.t)
                    book.declare(int(r.t), Zone(r.zone_id, r.lower, r.upper, r.role, 0.4 if pd.isna(r.base) else r.base))
                continue
            if last_t is not None and r.t <= last_t:
                out.append({"kind": "late", "t": r.t, "c": r.c})
                continue
            states = kind.states(kind.steps(np.array([r.h]), np.array([r.l]), np.array([r.c]), n, last_c), state)
            values = {k: None if np.isnan(x[0]) else float(x[0]) for k, x in kind.values(states, n).items()}
            state = states[:, 0].tolist()
            n, last_t, last_c = n + 1, int(r.t), float(r.c)
            out.append({"kind": "bar", "t": last_t, "c": last_c, **values})
            around = values[kind.names[-1]]
            if found := zigzag.step(last_t, r.h, r.l, None if around is None else self.multiple * around):
                out.append({"kind": "pivot", "t": last_t, "c": last_c, "pivot_t": found[0], "price": found[1], "pivot_kind": found[2]})
            for e in book.step(last_t, r.h, r.l, r.c, around, r.v):
                waiting.pop(e.zone_id, None)
                out.append({"kind": "zone", "t": e.t, "c": e.close, "zone_id": e.zone_id, "from_state": e.before, "state": e.state, "causes": e.causes, "tests": e.tests, "strength": e.strength, "outcome": e.outcome, "status": e.status})

        if last_t is not None:
            self.series.update((n, last_t, last_c, state, zigzag.dump()))
        for zone_id in book.changed:
            if zone_id in book.zones:
                self.zones.updateValue((zone_id,), (dump_zone(book.zones[zone_id], waiting.get(zone_id)),))
            elif self.zones.containsKey((zone_id,)):
                self.zones.removeKey((zone_id,))
        if self.idle is not None and last_t is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last_t + self.idle) * 1000)
        yield self._frame(symbol, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last_t = self.series.get()[1] if self.series.exists() else None
        self.series.clear()
        self.zones.clear()
        yield self._frame(key[0], [{"kind": "evicted", "t": last_t}])

    def _frame(self, symbol: str, rows: list[dict]) -> pd.DataFrame:
        columns = output_columns()
        pdf = pd.DataFrame([{**dict.fromkeys(columns), "symbol": symbol, **r} for r in rows], columns=list(columns), dtype=object)
        whole = {"long": "Int64", "int": "Int32", "double": "Float64"}
        return pdf.astype({k: whole[v] for k, v in columns.items() if v in whole})

    def close(self) -> None:
        pass


def stateful_bars(bars: DataFrame, zones: DataFrame | None = None, multiple: float = 2.0, policy: Policy = Policy(), idle: int | None = None) -> DataFrame:
    """Streams of closed bars (symbol, t, o, h, l, c, v) and of zones (symbol, zone_id, lower, upper, role, known_t, and strength if there is one)
    as rows of kind bar, pivot, zone, late and evicted, for append mode."""
    rows = bars.select("symbol", "t", *"ohlcv")
    if zones is not None:
        base = F.col("strength") if "strength" in zones.columns else F.lit(0.4)
        rows = rows.unionByName(zones.select("symbol", F.col("known_t").alias("t"), "zone_id", "lower", "upper", "role", base.alias("base")), allowMissingColumns=True)
    for name, kind in INPUT.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    mode = "None"
    if idle is not None:
        rows, mode = rows.withColumn("at", F.timestamp_seconds("t")).withWatermark("at", "0 seconds"), "EventTime"
    schema = ", ".join(f"{k} {v}" for k, v in output_columns().items())
    return rows.groupBy("symbol").transformWithStateInPandas(BarMachine(multiple, policy, idle), schema, "Append", mode)
