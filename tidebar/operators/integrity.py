"""Integrity of bar records: times off the grid, gaps, repeated times, impossible prices, a report of all of them, and manifests.

Records are rows (symbol, i, t, o, h, l, c, v): i is a row's place in its series' input, t its open time in epoch seconds or null. A boolean column ``zoned``
may mark rows whose time has no zone by false; their times count as unknown. Nothing is repaired, and rows of every symbol are judged apart.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical, iso
from .carried import sorted_pass

PRICES = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}


class MixedTimeframes(ValueError):
    """One series has rows of several timeframes."""


def _issue(df: DataFrame, kind: str | Column, detail: str | Column, part: int, t: str = "t", i: str | None = "i", place: str = "i") -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    row = F.col(i).cast("long") if i else F.lit(None).cast("long")
    return df.select("symbol", lit(kind).alias("kind"), F.col(t).cast("long").alias("t"), lit(detail).alias("detail"), row.alias("i"), F.lit(part).alias("part"), F.col(place).cast("long").alias("place"))


def _timed(records: DataFrame) -> DataFrame:
    zoned = F.coalesce("zoned", F.lit(True)) if "zoned" in records.columns else F.lit(True)
    return records.where(F.col("t").isNotNull() & zoned)


def _spans(records: DataFrame, step: int) -> DataFrame:
    """First and last slot of the grid between a symbol's first and last time; first > last where no slot lies between them."""
    return _timed(records).groupBy("symbol").agg((F.ceil(F.min("t") / step) * step).cast("long").alias("first"), (F.floor(F.max("t") / step) * step).cast("long").alias("last"))


def gaps(records: DataFrame, minutes: int) -> DataFrame:
    """symbol, t of every slot without a record: only the missing slots are made, from each time to the next."""
    step = 60 * minutes
    slots = _timed(records).where(F.col("t") % step == 0).select("symbol", "t").distinct()
    spans = _spans(records, step)
    edges = spans.select("symbol", F.explode(F.array(F.col("first") - step, F.col("last") + step)).alias("t"))
    after = F.lead("t").over(Window.partitionBy("symbol").orderBy("t"))
    holes = slots.unionByName(edges).withColumn("after", after).where(F.col("after") - F.col("t") > step)
    return holes.select("symbol", F.explode(F.sequence(F.col("t") + step, F.col("after") - step, F.lit(step).cast("long"))).alias("t"))


def duplicates(records: DataFrame) -> DataFrame:
    """symbol, t, copies, conflict, i for times that occur more than once; conflict: not all copies have the same values."""
    values = F.struct(*PRICES)
    found = records.where("t is not null").groupBy("symbol", "t").agg(F.count("*").alias("copies"), (~F.min(values).eqNullSafe(F.max(values))).alias("conflict"), F.min("i").alias("i"))
    return found.where("copies > 1")


def price_faults(records: DataFrame) -> DataFrame:
    """symbol, t, i, detail: all that is wrong with a record's values, joined by '; '."""
    value = {c: F.col(c).cast("double") for c in PRICES}
    broken = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    sound = {c: F.coalesce(~broken(x), F.lit(False)) for c, x in value.items()}
    listed = lambda bad: F.concat_ws(", ", *[F.when(bad(c), name) for c, name in PRICES.items()])
    missing, odd = listed(lambda c: F.col(c).isNull()), listed(lambda c: F.coalesce(broken(value[c]), F.lit(False)))
    o, h, low, c, v = value.values()
    whole = sound["o"] & sound["h"] & sound["l"] & sound["c"]
    problems = [
        F.when(missing != "", F.concat(F.lit("missing "), missing)),
        F.when(odd != "", F.concat(F.lit("non-finite "), odd)),
        F.when(whole & (h < low), "high < low"),
        F.when(whole & (h < F.greatest(o, c)), "high below max(open, close)"),
        F.when(whole & (low > F.least(o, c)), "low above min(open, close)"),
        F.when(sound["v"] & (v < 0), "volume is negative"),
    ]
    return records.select("symbol", "t", "i", F.concat_ws("; ", *problems).alias("detail")).where("detail <> ''")


def issues(records: DataFrame, minutes: int) -> DataFrame:
    """symbol, kind, t, detail, i, part, place; (part, place) orders a symbol's issues: times by row, missing slots, repeated times, values."""
    times = _issue(records.where("t is null"), "gap", "record missing open_time", 0)
    if "zoned" in records.columns:
        times = times.unionByName(_issue(records.where("t is not null and not zoned"), "naive_timestamp", "open_time has no zone", 0))
    times = times.unionByName(_issue(_timed(records).where(F.col("t") % (60 * minutes) != 0), "unaligned", "open_time is not on the grid", 0))
    copies = F.format_string("open_time appears %d times", F.col("copies"))
    copies = F.when(F.col("conflict"), F.concat(copies, F.lit(" with conflicting payloads"))).otherwise(copies)
    out = times.unionByName(_issue(gaps(records, minutes), "gap", "missing closed bar on the grid", 1, i=None, place="t"))
    return out.unionByName(_issue(duplicates(records), "duplicate", copies, 2)).unionByName(_issue(price_faults(records), "ohlc_violation", F.col("detail"), 3))


def report(records: DataFrame, minutes: int) -> DataFrame:
    """By symbol: ok, expected_slots, observed_count, unique_open_times, n_issues, and kinds, comma-joined in the order of their first issue."""
    step = 60 * minutes
    spans = _spans(records, step).select("symbol", F.greatest(F.lit(0).cast("long"), F.expr(f"(last - first) div {step} + 1")).alias("slots"))
    unique = _timed(records).groupBy("symbol", "t").agg(F.count("*").alias("k")).groupBy("symbol").agg(F.count("*").alias("times"))
    kinds = issues(records, minutes).groupBy("symbol", "kind").agg(F.min(F.struct("part", "place")).alias("first"), F.count("*").alias("k"))
    kinds = kinds.groupBy("symbol").agg(F.sum("k").alias("k"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "kind"))), lambda x: x["kind"]), ",").alias("kinds"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    rows = records.groupBy("symbol").agg(F.count("*").alias("observed_count")).join(spans, "symbol", "left").join(unique, "symbol", "left").join(kinds, "symbol", "left")
    return rows.select("symbol", F.col("k").isNull().alias("ok"), zero("slots").alias("expected_slots"), "observed_count", zero("times").alias("unique_open_times"), zero("k").alias("n_issues"), F.coalesce("kinds", F.lit("")).alias("kinds"))


def last_prints(records: DataFrame) -> DataFrame:
    """Of rows of one (symbol, t) the last of the input; a column ``timeframe`` may not differ within a symbol."""
    if "timeframe" in records.columns and not records.groupBy("symbol").agg(F.min("timeframe").alias("a"), F.max("timeframe").alias("b")).where("a <> b").isEmpty():
        raise MixedTimeframes("rows of several timeframes in one series")
    values = [c for c in records.columns if c not in ("symbol", "t")]
    return records.where("t is not null").groupBy("symbol", "t").agg(F.max_by(F.struct(*values), "i").alias("x")).select("symbol", "t", "x.*")


def payloads(bars: DataFrame, timeframe: str) -> DataFrame:
    """symbol, t, payload: a bar's canonical JSON."""
    record = F.struct("symbol", F.lit(timeframe).alias("timeframe"), iso(F.col("t")).alias("open_time"), F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"), F.col("v").alias("volume"))
    rows = bars.select("symbol", "t", record.alias("r"))
    return rows.select("symbol", "t", canonical(F.col("r"), rows.schema["r"].dataType).alias("payload"))


def manifest(bars: DataFrame, timeframe: str = "4h") -> DataFrame:
    """By symbol: bars, first_t, last_t, and the SHA-256 of all payloads in order of time, a line each. The digest runs over a series' sorted rows and holds none of them. No bars are an error."""
    if bars.isEmpty():
        raise ValueError("no bars for a manifest")
    rows = payloads(bars, timeframe).withColumn("last", F.lead("t").over(Window.partitionBy("symbol").orderBy("t")).isNull())

    def machine():
        digest, seen = hashlib.sha256(), []

        def step(r) -> list[tuple]:
            digest.update(r.payload.encode() + b"\n")
            seen[:] = [seen[0] + 1, seen[1]] if seen else [1, r.t]
            return [(r.symbol, seen[0], seen[1], r.t, digest.hexdigest())] if r.last else []

        return step

    return sorted_pass(rows, ["symbol"], ["t"], machine, "symbol string, bars long, first_t long, last_t long, sha256 string")


def verified(bars: DataFrame, expected: DataFrame) -> DataFrame:
    """symbol, same: whether the bars' manifest has the expected sha256; a symbol on one side only is not the same."""
    made = manifest(bars).select("symbol", F.col("sha256").alias("made"))
    both = made.join(expected.select("symbol", "sha256"), "symbol", "full")
    return both.select("symbol", F.coalesce(F.col("made") == F.col("sha256"), F.lit(False)).alias("same"))
