"""Block-carried recurrences and machines, the zone sweep, and their streamed form against plain folds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.operators.recurrences import Indicators, with_recurrences
from tidebar.operators.zones import Policy, Zone, ZoneBook, zigzag, zigzag_pivots, zone_events

BARS = "symbol string, t long, o double, h double, l double, c double, v double"


def walk(seed, n, step=3600, drop=0.0):
    r, c, out = random.Random(seed), 100.0, []
    for i in range(n):
        o, c = c, max(1.0, c + r.gauss(0, 1))
        if r.random() >= drop:
            out.append((i * step, o, max(o, c) + abs(r.gauss(0, 0.3)), min(o, c) - abs(r.gauss(0, 0.3)), c, float(i % 7)))
    return out


def frame(spark, series):
    return spark.createDataFrame([(s, *x) for s, rows in series.items() for x in rows], BARS)


def plain(rows):
    """The averages by their definitions, one bar after another."""
    out, closes = [], [x[4] for x in rows]
    emas, gains, losses, ranges = {}, [], [], []
    for i, (_, _, h, l, c, _) in enumerate(rows):  # noqa: E741
        for s in (9, 20, 50, 100, 200):
            k = 2 / (s + 1)
            emas[s] = c if i == 0 else k * c + (1 - k) * emas[s]
        before = closes[i - 1] if i else None
        ranges.append(h - l if i == 0 else max(h - l, abs(h - before), abs(l - before)))
        if i:
            gains.append(max(c - before, 0.0))
            losses.append(max(before - c, 0.0))
        if i == 14:
            g, q = sum(gains) / 14, sum(losses) / 14
        elif i > 14:
            g, q = (g * 13 + gains[-1]) / 14, (q * 13 + losses[-1]) / 14
        a = sum(ranges) / 14 if i == 13 else (a * 13 + ranges[-1]) / 14 if i > 13 else None
        out.append([*emas.values(), None if i < 14 else 100.0 if q == 0 else 100 - 100 / (1 + g / q), a])
    return out


@pytest.mark.parametrize("span", [3600, 5 * 3600, 40 * 3600, 10**9])
def test_recurrences_in_blocks_equal_the_fold(spark, span):
    series = {"a": walk(1, 300, drop=0.2), "b": walk(2, 9), "c": [(x[0], *[5.0 + x[0] / 3600] * 4, 1.0) for x in walk(3, 40)]}
    got = {}
    for r in with_recurrences(frame(spark, series), span).collect():
        got.setdefault(r.symbol, {})[r.t] = [r[n] for n in Indicators().names]
    for s, rows in series.items():
        for x, want in zip(rows, plain(rows), strict=True):
            assert [v is None for v in want] == [v is None for v in got[s][x[0]]]
            assert np.allclose([v for v in want if v is not None], [v for v in got[s][x[0]] if v is not None], rtol=1e-11, atol=1e-11)
    assert got["c"][20 * 3600][5] == 100.0


@pytest.mark.parametrize("span", [7 * 3600, 50 * 3600])
def test_zigzag_in_blocks_equals_the_fold(spark, span):
    series = {"a": walk(5, 400), "b": walk(6, 120, drop=0.3), "c": walk(7, 5)}
    bars = frame(spark, series)
    got = sorted(map(tuple, zigzag_pivots(bars, span=span).collect()))
    want = []
    for s, rows in series.items():
        need = [None if p[6] is None else 2.0 * p[6] for p in plain(rows)]
        want += [(s, rows[a][0], rows[b][0], p, k) for a, b, p, k in zigzag(range(len(rows)), [x[2] for x in rows], [x[3] for x in rows], need)]
    assert len(want) > 10 and got == sorted(want)


def zones_of(series, seed, n):
    r, out = random.Random(seed), []
    for s, rows in series.items():
        lows, highs = min(x[3] for x in rows), max(x[2] for x in rows)
        for i in range(n):
            mid, half = r.uniform(lows, highs), r.uniform(0.01, 1.5)
            out.append((s, f"z{i}", mid - half, mid + half, r.choice(["support", "resistance", "mixed"]), r.choice([-5, 0, 3600 * r.randint(0, 450)]), r.uniform(0.1, 0.9)))
    return out


def each_zone(rows, zones, policy):
    """Every zone stepped through every bar."""
    atrs, out = [p[6] for p in plain(rows)], []
    for s, zone_id, lower, upper, role, known, base in zones:
        zone = None
        for (t, _, h, l, c, v), a in zip(rows, atrs, strict=True):  # noqa: E741
            if t < known:
                continue
            if zone is None:
                zone = Zone(zone_id, lower, upper, role, base)
                zone.open(c)
                out.append((s, zone_id, t, "none", "approaching", "opened,range_declared", 0))
            if change := zone.step(h, l, c, a, v, policy):
                out.append((s, zone_id, t, change[0], zone.state, ",".join(change[1]), zone.tests))
    return out


@pytest.mark.parametrize("policy", [Policy(), Policy(mode="close_count", closes=3), Policy(mode="atr_distance", distance=0.8, retire=2.0), Policy(mode="both", retire=6.0, volume=5.0)])
def test_sweep_equals_every_zone_by_every_bar(spark, policy):
    series = {"a": walk(11, 400), "b": walk(12, 90), "flat": [(3600 * i, 50.0, 50.0, 50.0, 50.0, 1.0) for i in range(60)]}
    zones = zones_of(series, 4, 60)
    table = spark.createDataFrame(zones, "symbol string, zone_id string, lower double, upper double, role string, known_t long, strength double")
    for parts in (1, 3):
        got = sorted(tuple(r)[:7] for r in zone_events(frame(spark, series), table, policy, parts).collect())
        want = sorted(e for s, rows in series.items() for e in each_zone(rows, [z for z in zones if z[0] == s], policy))
        assert len(want) > 300 and got == want


def test_sweep_looks_at_few_zones(monkeypatch):
    """Zones far from price cost nothing: steps grow with bars and events, not with their product with zones."""
    rows, steps = walk(13, 2000), [0]
    plain_step = Zone.step
    monkeypatch.setattr(Zone, "step", lambda self, *a: (steps.__setitem__(0, steps[0] + 1), plain_step(self, *a))[1])
    book = ZoneBook()
    for i in range(5000):
        book.declare(0, Zone(f"z{i}", 1000.0 + i, 1000.4 + i, "resistance"))
    events = sum(len(book.step(t, h, l, c, 1.0, v)) for t, _, h, l, c, v in rows)  # noqa: E741
    assert events == 5000 and steps[0] <= 5000 + len(rows)


def test_zone_rules():
    z = Zone("z", 10.0, 11.0, "resistance")
    assert z.step(10.4, 9.0, 9.5, 5.0) == ("approaching", ("probe",)) and z.tests == 1
    assert z.step(9.9, 9.0, 9.5, 5.0) == ("testing", ("rejected_close_origin",)) and z.outcome == "held" and abs(z.strength - 0.48) < 1e-12
    assert z.step(11.6, 10.5, 11.5, 5.0) == ("rejected", ("close_beyond",))
    assert z.step(11.6, 11.1, 11.5, 5.0) == ("penetrated", ("acceptance_beyond", "close_beyond")) and z.outcome == "accepted_through"
    assert abs(z.strength - 0.4 * 0.45) < 1e-12
    assert z.step(11.4, 10.5, 10.8, 5.0) == ("accepted", ("retest_opposite_side",))
    assert z.step(10.2, 7.0, 7.4, 5.0) == ("retesting", ("reclaim_acceptance", "successful_reclaim")) and z.outcome == "failed_breakout"
    assert z.step(5.0, -11.0, -10.5, 5.0) == ("reclaimed", ("retired_extended_origin", "bounds_frozen"))
    assert z.step(5.0, -11.0, -10.5, 5.0) is None
    down = Zone("d", 10.0, 11.0, "support")
    down.open(12.0)
    assert down.step(12.0, 9.0, 9.5, 2.0) == ("approaching", ("close_beyond",)) or down.state == "accepted"
    with pytest.raises(KeyError):
        Zone("z", 1.0, 2.0, "mixed").step(3.0, 2.5, 2.8, 1.0, 0.0, Policy(mode="never"))


def test_stream_restarted_equals_batch(spark, tmp_path):
    from tidebar.streaming.stateful import stateful_bars, with_store

    series = {"a": walk(21, 150), "b": walk(22, 90, drop=0.3)}
    zones = zones_of(series, 8, 15)
    kinds = "symbol string, zone_id string, lower double, upper double, role string, known_t long, strength double"
    # a zone is known no later than its row arrives: all rows up to a bar's time come with it or before
    marks = [0, 20, 21, 60, 110, 150]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with_store(spark)
    try:
        for no, (a, b) in enumerate(zip(marks, marks[1:], strict=False)):
            within = lambda t: a * 3600 <= t < b * 3600 or (a == 0 and t < 0) or (b == 150 and t >= b * 3600)  # noqa: B023, E731
            part = {s: [x for x in rows if within(x[0])] for s, rows in series.items()}
            rows = frame(spark, part).orderBy(F.rand(1)).withColumn("zone_id", F.lit(None).cast("string"))
            declared = spark.createDataFrame([z for z in zones if within(z[5])], kinds).withColumnRenamed("known_t", "t")
            rows.unionByName(declared, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            if no in (2, 4):  # two runs, each of several micro-batches, from one checkpoint
                source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
                bars = source.where("zone_id is null").select("symbol", "t", *"ohlcv")
                known = source.where("zone_id is not null").select("symbol", "zone_id", "lower", "upper", "role", F.col("t").alias("known_t"), "strength")
                q = stateful_bars(bars, known).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
                q.awaitTermination(240)
                assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    out = spark.read.parquet(str(tmp_path / "out")).cache()
    bars = frame(spark, series)
    names = Indicators().names
    got = {(r.symbol, r.t): [r[n] for n in names] for r in out.where("kind = 'bar'").collect()}
    want = {(r.symbol, r.t): [r[n] for n in names] for r in with_recurrences(bars).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert [x is None for x in w] == [x is None for x in got[k]]
        assert np.allclose([x for x in w if x is not None], [x for x in got[k] if x is not None], rtol=1e-9)
    pivots = sorted((r.symbol, r.pivot_t, r.t, r.price, r.pivot_kind) for r in out.where("kind = 'pivot'").collect())
    assert pivots and pivots == sorted(map(tuple, zigzag_pivots(bars).collect()))
    events = lambda df: sorted((r.symbol, r.zone_id, r.t, r.from_state, r.state, r.causes, r.tests, r.outcome) for r in df.collect())
    assert events(out.where("kind = 'zone'")) == events(zone_events(bars, spark.createDataFrame(zones, kinds)))
    assert out.where("kind = 'late'").count() == 0


def test_stream_refuses_late_bars_and_evicts_idle_symbols(spark, tmp_path):
    from tidebar.streaming.stateful import stateful_bars, with_store

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with_store(spark)
    rows = walk(31, 60)
    batches = [{"a": rows[:20], "b": rows[:30]}, {"a": rows[19:21], "b": rows[30:55]}, {"b": rows[55:58]}, {"a": rows[57:58], "b": rows[58:]}]
    try:
        for part in batches:
            frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stateful_bars(source, idle=20 * 3600).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert [(r.symbol, r.t) for r in out.where("kind = 'late'").collect()] == [("a", rows[19][0])]
    assert ("a", rows[20][0]) in [(r.symbol, r.t) for r in out.where("kind = 'evicted'").collect()]
    # a new series: its average begins with its own close
    again = out.where(f"kind = 'bar' and symbol = 'a' and t = {rows[57][0]}").first()
    assert again.ema9 == again.c


@pytest.mark.parametrize("span", [4 * 3600, 86400])
def test_first_passages_equal_a_scan(spark, monkeypatch, span):
    from tidebar.operators import first_passage as fp

    monkeypatch.setattr(fp, "FAN", 4)
    series = {"a": walk(51, 700, drop=0.1), "b": walk(52, 30), "gap": walk(53, 20) + [(3600 * (400 + i), *x[1:]) for i, x in enumerate(walk(54, 20))]}
    r, searches = random.Random(2), []
    for s, rows in series.items():
        for i in range(250):
            x = r.choice(rows)
            searches.append((s, i, x[0] + r.choice([0, 0, 7, 3600]), r.choice(list(fp.KINDS)), x[4] + r.choice([0.0, r.gauss(0, 3), 40.0])))
    out = fp.first_passages(frame(spark, series), spark.createDataFrame(searches, "symbol string, no long, from_t long, kind string, price double"), span).collect()
    assert len(out) == len(searches)
    for x in out:
        rows = series[x.symbol]
        # pair: the lesser of a close and the one before it
        pairs = [None] + [min(a[4], b[4]) for a, b in zip(rows, rows[1:], strict=False)]
        value = {"c": [v[4] for v in rows], "h": [v[2] for v in rows], "l": [v[3] for v in rows], "range": [v[2] - v[3] for v in rows], "pair": pairs}
        end, what, equal = fp.KINDS[x.kind]
        beyond = {("max", False): lambda v: v > x.price, ("max", True): lambda v: v >= x.price, ("min", False): lambda v: v < x.price, ("min", True): lambda v: v <= x.price}[end, equal]  # noqa: B023
        want = next((row[0] for row, v in zip(rows, value[what], strict=True) if row[0] >= x.from_t and v is not None and beyond(v)), None)
        assert x.hit_t == want, x
