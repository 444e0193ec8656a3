import math
import random

import pytest

from tidebar.operators import forecasts, swings
from tidebar.sources.fixture import breakout_bars

BARS = "symbol string, t long, o double, h double, l double, c double, v double"


def test_published_errors_of_the_fixture(spark):
    """The reference's own figures: origins from the 200th bar, every 40th, and from the 400th, every 150th."""
    bars = breakout_bars(spark).cache()
    assert bars.count() == 3768
    got = {r.h: r for r in forecasts.walk_forward_gated(bars, 5, 240, 199, 40).collect()}
    assert got[1].n == 89
    want = {"gated_mae": (2.35e-5, 2.14e-5, 1.88e-5), "drift_mae": (2.62e-5, 3.48e-5, 4.57e-5), "zero_mae": (7.82e-5, 2.95e-4, 5.65e-4)}
    for name, values in want.items():
        assert [got[h][name] for h in (1, 5, 10)] == [pytest.approx(v, rel=6e-3) for v in values]
    got = {r.h: r for r in forecasts.walk_forward_gated(bars, 5, 240, 399, 150).collect()}
    want = {"zero_mae": (5.69e-5, 2.85e-4, 5.69e-4), "drift_mae": (3.98e-8, 2.39e-7, 5.77e-7), "gated_mae": (8.53e-7, 4.31e-6, 8.71e-6)}
    assert got[1].n == 23
    for name, values in want.items():
        assert [got[h][name] for h in (1, 5, 10)] == [pytest.approx(v, rel=6e-3) for v in values]


def test_probabilities_equal_a_plain_loop(spark):
    r = random.Random(1)
    c = [100.0]
    for _ in range(400):
        c.append(c[-1] * math.exp(r.gauss(0.0002, 0.01)))
    bars = spark.createDataFrame([("a", 60 * k, x, x, x, x, 1.0) for k, x in enumerate(c)], BARS)
    drift = lambda t: sum(math.log(c[k] / c[k - 1]) for k in range(t - 18, t + 1)) / 19
    starts = list(range(79, len(c) - 10, 7))
    want = {}
    for t in starts:
        for h in range(1, 11):
            prior = [(math.log(c[s + h] / c[s]), drift(s) * h) for s in starts if s < t and s + h <= t]
            own = drift(t) * h
            side = [y > 0 for y, p in prior if own == 0 or p * own > 0]
            e = sorted(y - p for y, p in prior)
            q = lambda x: e[int((len(e) - 1) * x)] * (1 - (len(e) - 1) * x % 1) + e[min(int((len(e) - 1) * x) + 1, len(e) - 1)] * ((len(e) - 1) * x % 1)  # noqa: E731, B023
            want[60 * t, h] = (len(prior), sum(side) / len(side) if len(side) >= 8 else None, own + q(0.1) if len(e) >= 8 else None, own + q(0.9) if len(e) >= 8 else None)
    got = {(x.t, x.h): (x.prior, x.p_up, x.q10, x.q90) for x in forecasts.signed_probabilities(bars, 79, 7).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert all((a is None and b is None) or a == pytest.approx(b, abs=1e-12) for a, b in zip(got[k], w, strict=True))


def test_swings_collapse_runs_of_one_kind(spark):
    rows = [("a", 1, 4, 10.0, "low"), ("a", 2, 5, 20.0, "high"), ("a", 3, 6, 22.0, "high"), ("a", 4, 7, 22.0, "high"), ("a", 5, 8, 16.0, "low"), ("a", 6, 9, 30.0, "high")]
    pivots = spark.createDataFrame(rows, "symbol string, t long, known_t long, price double, kind string")
    got = sorted(tuple(r) for r in swings.anchors(pivots).collect())
    assert got == [("a", 1, 3, 6, 10.0, 22.0, "up"), ("a", 3, 5, 8, 22.0, 16.0, "down"), ("a", 5, 6, 9, 16.0, 30.0, "up")]
    moves = sorted((r.end_t, r.correction_t, r.known_t, r.ratio, round(r.price, 9)) for r in swings.measured_moves(pivots).collect())
    assert moves == [(3, 5, 8, q, round(16 + 12 * q, 9)) for q in (1.0, 1.272, 1.618)]
    found = {(r.start_t, r.kind, r.ratio): r.price for r in swings.levels(pivots).collect()}
    assert len(found) == 3 * 11
    assert found[1, "retracement", 0.5] == 16.0 and found[1, "extension", 2.0] == 34.0 and found[3, "retracement", 1.0] == 22.0


def test_plateaus_of_three_equal_highs_or_lows(spark):
    h, l = [5.0, 6.0, 6.0, 6.0, 6.0, 5.0, 5.0], [1.0, 1.0, 1.0, 0.0, 2.0, 2.0, 3.0]  # noqa: E741
    bars = spark.createDataFrame([("a", k, 3.0, x, y, 3.0, 1.0) for k, (x, y) in enumerate(zip(h, l, strict=True))], BARS)
    got = sorted(tuple(r[c] for c in ("role", "price", "first_t", "known_t", "bars")) for r in swings.plateaus(bars).collect())
    assert got == [("resistance", 6.0, 1, 3, 4), ("support", 1.0, 0, 2, 3)]
