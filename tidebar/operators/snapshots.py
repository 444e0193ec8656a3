"""The whole state of a series at every base bar, as columns: timeframes in the context of their parents, analogs, levels of the last swing, and theses.

All bars are done at once; a snapshot as of some time is a row, not a rebuild on the bars up to then. Whatever a row holds was known with its bar's close: parents and theses are attached as of that time,
swings are those whose pivots were confirmed by then, with the extremes that their runs had by then.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analogs import analogs
from .asof import asof_attach
from .carried import sorted_pass
from .regimes import confirmed_pivots, timeframe_states
from .resample import resample
from .swings import EXTENSIONS, RETRACEMENTS
from .theses import LEAST_BARS, TAIL, canonical, rebuilt_theses, relief_theses, sha256, with_structure

#: The versions that a written snapshot names, and the levels it holds.
ENGINE, SCHEMA_VERSION, LEVELS = "tidebar-1", "1", 8
_PARTS = ("regime", "swing", "volatility")


def timeframe_columns(bars: DataFrame, minutes: int, parents: dict[str, int], label: str = "base") -> DataFrame:
    """symbol, t, known, o, h, l, c, v, and a struct (regime, swing, volatility) for the base and each parent (minutes by label, longest first), null before its first complete bar.

    A neutral timeframe takes the direction of the nearest decided one above it, as a transition.
    """
    own = timeframe_states(bars).select("symbol", "t", F.struct(*_PARTS).alias(label))
    df = bars.join(own, ["symbol", "t"]).withColumn("known", F.col("t") + 60 * minutes)
    for name, width in parents.items():
        states = timeframe_states(resample(bars, minutes, width)).select("symbol", (F.col("t") + 60 * width).alias("known_"), F.struct(*_PARTS).alias(name))
        df = asof_attach(df, states, "known", "known_", [name])
    above: Column = F.lit(None).cast("string")
    for name in [*parents, label]:
        regime = F.col(f"own_{name}.regime")
        df = df.withColumn(f"own_{name}", F.col(name))
        bent = F.when((regime == "neutral") & (above == "bullish"), "transition_up").when((regime == "neutral") & (above == "bearish"), "transition_down").otherwise(regime)
        df = df.withColumn(name, F.when(F.col(name).isNotNull(), F.col(name).withField("regime", bent)))
        above = F.coalesce(F.when(regime.isin("bullish", "bearish"), regime), above)
    return df.drop(*(f"own_{n}" for n in [*parents, label]))


def parent_regime(parents: dict[str, int]) -> Column:
    """The regime of the longest decided parent."""
    return F.coalesce(*[F.when(F.col(f"{p}.regime").isin("bullish", "bearish"), F.col(f"{p}.regime")) for p in parents], F.lit("unknown"))


def interpretation(parent: Column, child: Column, label: str) -> Column:
    against = ((parent == "bullish") & child.isin("bearish", "transition_down")) | ((parent == "bearish") & child.isin("bullish", "transition_up"))
    relief = F.concat(F.lit(f"{label} "), child, F.lit(" is relief/countertrend inside "), parent, F.lit(" higher-timeframe regime, not a reversal"))
    return F.when(against, relief).when(parent != "unknown", F.concat(F.lit("higher-timeframe regime "), parent, F.lit(f"; {label} must not silently overwrite it"))).otherwise("")


def last_swing_levels(bars: DataFrame) -> DataFrame:
    """symbol, known_t, levels: at each newly known pivot the first LEVELS ratio levels of the last swing between a finished run of pivots of one kind and the extreme of the run that goes on."""
    pivots = confirmed_pivots(bars)
    by = Window.partitionBy("symbol").orderBy("t", "known_t", "kind")
    df = pivots.withColumn("new", F.coalesce((F.lag("kind").over(by) != F.col("kind")).cast("int"), F.lit(1)))
    df = df.withColumn("run", F.sum("new").over(by))
    height = F.when(F.col("kind") == "high", F.col("price")).otherwise(-F.col("price"))
    so_far = Window.partitionBy("symbol", "run").orderBy("t", "known_t").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("end", F.max_by(F.struct("t", "price"), F.struct(height, -F.col("t"))).over(so_far))
    # the run before is finished once another has begun: its end is that of the row before the run's first
    df = df.withColumn("before", F.when(F.col("new") == 1, F.lag("end").over(by)))
    df = df.withColumn("start", F.first("before").over(so_far)).drop("before")
    span = F.col("end.price") - F.col("start.price")
    level = lambda kind, r, price: F.struct(F.lit(kind).alias("kind"), F.lit(r).alias("ratio"), price.alias("price"))
    made = [level("retracement", r, F.col("end.price") - span * r) for r in RETRACEMENTS] + [level("extension", r, F.col("start.price") + span * r) for r in EXTENSIONS]
    df = df.where(F.col("start").isNotNull() & (span != 0)).select("symbol", "t", "known_t", F.array(*made[:LEVELS]).alias("levels"))
    # two pivots can become known at once; the later one in time counts
    return df.groupBy("symbol", "known_t").agg(F.max_by("levels", "t").alias("levels"))


def thesis_columns(bars: DataFrame, minutes: int, parent: int, label: str) -> DataFrame:
    """symbol, known, direction and the state of the direction's last thesis version of the parent's bars, at each change."""
    above = resample(bars, minutes, parent)
    states = with_structure(above).join(timeframe_states(above).select("symbol", "t", "regime"), ["symbol", "t"])
    states = states.select("symbol", "t", (F.col("t") + 60 * parent).alias("known"), "h", "l", "c", "regime", "top", "bottom")
    versions = rebuilt_theses(states, label).where("what = 'version'")
    # of several changes at one time the last: a version is closed before the next is opened
    return versions.groupBy("symbol", F.col("at").alias("known_"), "direction").agg(
        F.max_by(F.struct("thesis_id", "direction", "kind", "status", "version", "created_at", "closed_at", "closure_reason", "fired", "confirmation_rules", "invalidation_rules", "invalidation_fingerprint"), F.struct("version", F.col("status") == "closed")).alias("thesis")
    )


def snapshots(bars: DataFrame, minutes: int, parents: dict[str, int], thesis_parent: str, label: str = "base") -> DataFrame:
    """One row per base bar: symbol, t, as_of, a struct by timeframe, parent_regime, interpretation, analogs, levels, bear, bull and relief theses."""
    df = timeframe_columns(bars, minutes, parents, label)
    df = df.withColumn("parent_regime", parent_regime(parents))
    df = df.withColumn("interpretation", interpretation(F.col("parent_regime"), F.col(f"{label}.regime"), label))

    theses = thesis_columns(bars, minutes, parents[thesis_parent], thesis_parent)
    s = Window.partitionBy("symbol").orderBy("t")
    for direction, regime in (("bear", "bearish"), ("bull", "bullish")):
        own = theses.where(F.col("direction") == direction).select("symbol", "known_", F.col("thesis").alias(direction))
        df = asof_attach(df, own, "known", "known_", [direction])
        relation = F.when(F.col("parent_regime") == regime, "aligned").otherwise("mixed")
        df = df.withColumn(direction, F.when(F.col(direction).isNotNull(), F.col(direction).withField("regime_relation", relation)))
    # too little history for theses
    parents_seen = F.floor(F.col("known") / (60 * parents[thesis_parent])) - F.floor(F.min("t").over(s.rowsBetween(Window.unboundedPreceding, 0)) / (60 * parents[thesis_parent]))
    enough = (F.row_number().over(s) >= TAIL) & (parents_seen >= LEAST_BARS)
    df = df.withColumns({d: F.when(enough, F.col(d)) for d in ("bear", "bull")})
    reliefs = relief_theses(df.select("symbol", "t", "h", "l", "c", F.col(f"{label}.regime").alias("regime"), F.coalesce(F.col("bear.status") == "active", F.lit(False)).alias("bear_live")))
    status = F.when(F.col("closed_t").isNull(), "active").otherwise("closed")
    reliefs = reliefs.select("symbol", "t", F.struct(F.lit("ltf_relief").alias("kind"), status.alias("status"), (F.col("relief_t") + 60 * minutes).alias("created_at"), (F.col("closed_t") + 60 * minutes).alias("closed_at"), "confirm_price", "invalid_price").alias("relief"))

    near = analogs(bars).groupBy("symbol", "t").agg(F.array_sort(F.collect_list(F.struct("rank", "origin_t", "known_t", "distance", "realized"))).alias("analogs"))
    df = reduce(lambda a, b: a.join(b, ["symbol", "t"], "left"), (reliefs, near), df)
    df = asof_attach(df.withColumn("_known", F.col("t")), last_swing_levels(bars).withColumnRenamed("known_t", "known_"), "_known", "known_", ["levels"])
    return df.select("symbol", "t", F.col("known").alias("as_of"), label, *parents, "parent_regime", "interpretation", "analogs", "levels", "bear", "bull", "relief")


def source_hashes(bars: DataFrame) -> DataFrame:
    """symbol, t, source_data_hash: at each bar the SHA-256 of the canonical JSON of all bars up to it. The digest goes on from bar to bar; no prefix is read twice."""

    def machine():
        digest = hashlib.sha256(b"[")
        begun = [False]

        def step(r) -> list[tuple]:
            record = canonical({"symbol": r.symbol, "open_time": r.t, "open": r.o, "high": r.h, "low": r.l, "close": r.c, "volume": r.v})
            digest.update(("," if begun[0] else "").encode() + record.encode())
            begun[0] = True
            whole = digest.copy()
            whole.update(b"]")
            return [(r.symbol, r.t, "sha256:" + whole.hexdigest())]

        return step

    return sorted_pass(bars.select("symbol", "t", *"ohlcv"), ["symbol"], ["t"], machine, "symbol string, t long, source_data_hash string")


def persisted(snaps: DataFrame, bars: DataFrame, timeframes: list[str]) -> DataFrame:
    """symbol, t, as_of, source_data_hash, canonical_json, payload_sha256 of every snapshot."""
    rows = snaps.select("symbol", "t", "as_of", *timeframes).join(source_hashes(bars), ["symbol", "t"])

    def write(batches):
        for pdf in batches:
            texts = []
            for r in pdf.itertuples(index=False):
                states = {n: {k: s[k] for k in _PARTS} for n in timeframes if (s := getattr(r, n)) is not None}
                print_ = {f"{k}_{n}": s[k] for n, s in states.items() for k in _PARTS}
                texts.append(canonical({"as_of": r.as_of, "known_at": r.as_of, "engine_version": ENGINE, "schema_version": SCHEMA_VERSION, "fingerprint": {"schema_version": SCHEMA_VERSION, "values": print_}, "source_data_hash": r.source_data_hash, "symbol": r.symbol, "timeframes": states}))
            yield pd.DataFrame({"symbol": pdf["symbol"], "t": pdf["t"], "as_of": pdf["as_of"], "source_data_hash": pdf["source_data_hash"], "canonical_json": texts, "payload_sha256": [sha256(x) for x in texts]})

    return rows.mapInPandas(write, "symbol string, t long, as_of long, source_data_hash string, canonical_json string, payload_sha256 string")


def transitions(written: DataFrame, snaps: DataFrame, timeframes: list[str]) -> DataFrame:
    """symbol, as_of, entity, from_regime, to_regime, input_snapshot: changes of a timeframe's regime from one snapshot to the next; a timeframe that was not there before was unknown."""
    each = F.array(*[F.struct(F.lit(n).alias("timeframe"), F.col(f"{n}.regime").alias("regime")) for n in timeframes])
    rows = snaps.join(written.select("symbol", "t", "payload_sha256"), ["symbol", "t"]).select("symbol", "t", "as_of", "payload_sha256", F.inline(each))
    s = Window.partitionBy("symbol", "timeframe").orderBy("t")
    rows = rows.withColumn("old", F.coalesce(F.lag("regime").over(s), F.lit("unknown"))).withColumn("first", F.row_number().over(s) == 1)
    rows = rows.where(~F.col("first") & F.col("regime").isNotNull() & (F.col("old") != F.col("regime")))
    return rows.select("symbol", "as_of", F.concat("symbol", F.lit(":"), "timeframe").alias("entity"), F.col("old").alias("from_regime"), F.col("regime").alias("to_regime"), F.concat(F.lit("sha256:"), "payload_sha256").alias("input_snapshot"))


def as_of(snaps: DataFrame, when: DataFrame) -> DataFrame:
    """The last snapshot of each symbol known at its time; ``when`` is symbol, at."""
    columns = [c for c in snaps.columns if c != "symbol"]
    return asof_attach(when, snaps, "at", "as_of", columns)
