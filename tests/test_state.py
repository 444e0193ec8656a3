"""Analogs, theses and snapshots: brute force, a plain ledger, and rebuilds on prefixes."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_carried import frame, walk

from tidebar.operators import analogs as near
from tidebar.operators import snapshots as snap
from tidebar.operators import theses
from tidebar.sources.fixture import breakout_bars

PARENTS = {"d1": 1440, "h4": 240}


@pytest.mark.parametrize("power", [2, 10])
def test_analogs_equal_brute_force(spark, monkeypatch, power):
    monkeypatch.setattr(near, "POWER", power)
    flat = [(3600 * i, 5.0, 5.0, 5.0, 5.0 if i % 50 else 0.0, 1.0) for i in range(300)]
    series = {"a": walk(1, 2600), "b": walk(2, 95), "c": walk(3, 80), "flat": flat}
    got = {}
    for r in near.analogs(frame(spark, series)).collect():
        got.setdefault((r.symbol, r.t), []).append((r["rank"], r.origin_t, r.known_t, round(r.distance, 10), round(r.realized, 10)))
    for s, rows in series.items():
        c = [x[4] for x in rows]
        log = lambda a, b: np.log(b / a) if a > 0 and b > 0 else None

        def fingerprint(i, c=c, log=log):
            r = [x for j in range(max(1, i - 23), i + 1) if (x := log(c[j - 1], c[j])) is not None]
            return np.array([*(0.0 if i < k else log(c[i - k], c[i]) or 0.0 for k in (12, 24)), np.sqrt(np.mean(np.square(r))) if r else 0.0])

        prints = np.array([fingerprint(i) for i in range(len(c))])
        for i in range(90, len(c)):
            origins = [j for j in range(80, i - 9, 8) if c[j] > 0 and c[j + 10] > 0]
            d = np.sqrt(((prints[origins] - prints[i]) ** 2).sum(axis=1)) if origins else []
            best = sorted(zip(d, origins, strict=True))[:5]
            want = [(k, rows[j][0], rows[j + 10][0], round(float(x), 10), round(float(log(c[j], c[j + 10])), 10)) for k, (x, j) in enumerate(best, 1)]
            assert sorted(got.get((s, rows[i][0]), [])) == want


def commands(spark, rows):
    names = [f.split()[0] for f in theses.COMMANDS.replace("\n", " ").split(", ") if not f.startswith(("kind:", "price:", "timeframe:", "description:"))]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], theses.COMMANDS)


def a_rule(name, kind, price, timeframe="4h"):
    return {"id": name, "kind": kind, "price": price, "timeframe": timeframe, "description": ""}


def test_ledger_never_moves_an_invalidation(spark):
    up, down = a_rule("up", "close_above", 12.0), a_rule("down", "close_below", 9.0)
    listed = [
        dict(op="open", thesis_id="x-v1", lineage_id="x", direction="bull", kind="break", text="seen", confirmation=[up], invalidation=[down]),
        dict(op="open", thesis_id="x-v1", lineage_id="x", direction="bull", kind="break", confirmation=[up], invalidation=[down]),
        dict(op="open", thesis_id="y", lineage_id="y", direction="bear", kind="break", confirmation=[up], invalidation=[]),
        dict(op="move", thesis_id="x-v1", rule_id="down", price=8.0),
        dict(op="fire", thesis_id="x-v1", timeframe="5m", h=9.0, l=1.0, c=2.0),
        dict(op="evidence", thesis_id="x-v1", text="more"),
        dict(op="counter", thesis_id="x-v1", text="less"),
        dict(op="revise", thesis_id="x-v1", confirmation=[up]),
        dict(op="revise", thesis_id="x-v1", invalidation=[a_rule("down", "low_below", 8.5)], text="wick"),
        dict(op="evidence", thesis_id="x-v1", text="late"),
        dict(op="fire", thesis_id="x-v2", timeframe="4h", h=9.0, l=8.6, c=8.7),
        dict(op="fire", thesis_id="x-v2", timeframe="4h", h=9.0, l=8.4, c=8.7),
        dict(op="fire", thesis_id="x-v2", timeframe="4h", h=9.0, l=8.0, c=8.0),
        dict(op="dance", thesis_id="x-v2"),
    ]
    rows = [{"symbol": s, "seq": i, "at": 100 + i, **c} for s in ("a", "b") for i, c in enumerate(listed)]
    out = theses.ledger(commands(spark, rows)).collect()
    assert len({r.symbol for r in out}) == 2
    events = [(r.at - 100, r.thesis_id, r.action) for r in out if r.symbol == "a" and r.what == "event"]
    assert events == [
        (0, "x-v1", "opened"), (1, "x-v1", "refused"), (2, "y", "refused"), (3, "x-v1", "rejected_invalidation_move"), (5, "x-v1", "evidence_appended"), (6, "x-v1", "evidence_appended"),
        (7, "x-v1", "refused"), (8, "x-v2", "opened"), (8, "x-v1", "superseded"), (9, "x-v1", "refused"), (11, "x-v2", "invalidated"), (12, "x-v2", "refused"), (13, "x-v2", "refused"),
    ]
    versions = [r for r in out if r.symbol == "a" and r.what == "version"]
    seals = {}
    for r in versions:
        assert seals.setdefault(r.thesis_id, r.invalidation_fingerprint) == r.invalidation_fingerprint
    assert json.loads(versions[-1].evidence) == ["seen", "more"] and versions[-1].fired == "down" and versions[-1].supersedes == "x-v1"
    one = hashlib.sha256(b'{"description":"","id":"down","kind":"close_below","price":9.0,"timeframe":"4h"}').hexdigest()
    assert seals["x-v1"] == hashlib.sha256(f'["{one}"]'.encode()).hexdigest()


def test_rebuilt_theses_equal_a_plain_ledger(spark):
    """The breakout fixture and random walks, by four-hour bars."""
    from tidebar.operators.regimes import timeframe_states
    from tidebar.operators.resample import resample

    bars = resample(breakout_bars(spark), 5, 240).unionByName(frame(spark, {"a": walk(3, 300, 14400), "b": walk(9, 300, 14400)}).select("symbol", "t", *"ohlcv"))
    states = theses.with_structure(bars).join(timeframe_states(bars).select("symbol", "t", "regime"), ["symbol", "t"]).withColumn("known", F.col("t") + 14400).cache()
    out = theses.rebuilt_theses(states, "4h").where("what = 'version'").collect()
    got = {}
    for r in out:
        price = lambda x: json.loads(x)[0]["price"]
        got[r.symbol, r.direction, r.version] = (r.created_at, r.closed_at, price(r.confirmation_rules), price(r.invalidation_rules))
    want, series = {}, {}
    for r in states.orderBy("symbol", "t").collect():
        series.setdefault(r.symbol, []).append(r)
    for s, rows in series.items():
        for direction, regime in (("bear", "bearish"), ("bull", "bullish")):
            version, live = 0, None
            for i, r in enumerate(rows):
                highs = [rows[j].h for j in range(3, i - 2) if all(rows[j].h > rows[k].h for k in range(j - 3, j + 4) if k != j)]
                lows = [rows[j].l for j in range(3, i - 2) if all(rows[j].l < rows[k].l for k in range(j - 3, j + 4) if k != j)]
                top, bottom = max(highs or [x.h for x in rows[: i + 1]]), min(lows or [x.l for x in rows[: i + 1]])
                top = bottom * 1.002 if top <= bottom else top
                if live and (r.c > live[1] if direction == "bear" else r.c < live[1]):
                    want[s, direction, version] = (*want[s, direction, version][:1], r.known, *want[s, direction, version][2:])
                    live = None
                if r.regime == regime and not live:
                    version += 1
                    live = (bottom, top) if direction == "bear" else (top, bottom)
                    want[s, direction, version] = (r.known, None, *live)
    assert len(want) > 8 and got == want


def plain(row):
    return json.loads(json.dumps(row.asDict(recursive=True)))


def test_snapshots_equal_rebuilds_on_prefixes(spark):
    """Whatever comes later: the row of a bar is the last row of the snapshots of the bars up to it, for twenty bars of two series."""
    series = {"a": walk(41, 420), "b": walk(42, 400, drop=0.1)}
    bars = frame(spark, series)
    full = {(r.symbol, r.t): plain(r) for r in snap.snapshots(bars, 60, PARENTS, "h4", "h1").collect()}
    assert len(full) == sum(map(len, series.values()))
    assert all(any(r[k] for r in full.values()) for k in ("analogs", "levels", "bear", "bull", "d1"))
    # twenty prefixes at once: each is a series of its own
    cuts = {f"{s}{i}": rows[: 60 + i * 35] for s, rows in series.items() for i in range(10)}
    last = {s: rows[-1][0] for s, rows in cuts.items()}
    some = snap.snapshots(frame(spark, cuts), 60, PARENTS, "h4", "h1")
    for r in some.collect():
        if r.t == last[r.symbol]:
            own, whole = plain(r), full[r.symbol[0], r.t]
            for row, name in ((own, r.symbol), (whole, r.symbol[0])):
                for d in ("bear", "bull"):
                    if row[d]:
                        row[d]["thesis_id"] = row[d]["thesis_id"].removeprefix(name)
            assert own | {"symbol": 0} == whole | {"symbol": 0}


def test_written_snapshots_hash_whole_prefixes(spark):
    series = {"a": walk(43, 60)}
    bars = frame(spark, series)
    snaps = snap.snapshots(bars, 60, PARENTS, "h4", "h1")
    rows = snap.persisted(snaps, bars, ["h1", "h4", "d1"]).orderBy("t").collect()
    for i in (0, 7, 59):
        records = [{"symbol": "a", "open_time": x[0], "open": x[1], "high": x[2], "low": x[3], "close": x[4], "volume": x[5]} for x in series["a"][: i + 1]]
        assert rows[i].source_data_hash == "sha256:" + hashlib.sha256(json.dumps(records, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        assert rows[i].payload_sha256 == hashlib.sha256(rows[i].canonical_json.encode()).hexdigest()
        assert json.loads(rows[i].canonical_json)["source_data_hash"] == rows[i].source_data_hash
    when = spark.createDataFrame([("a", 7200 + 5), ("a", 100)], "symbol string, at long")
    found = {r["at"]: r.t for r in snap.as_of(snaps, when).select("at", "t").collect()}
    assert found == {7205: 3600, 100: None}
