"""Level outcomes, records, journals and the exact grid on small made series."""

import math

import pytest

from tidebar.operators import integrity, journal, rules
from tidebar.operators.cross_market import cross_market

RECORD = "symbol string, i long, t long, o double, h double, l double, c double, v double"


@pytest.mark.parametrize(
    "closes, outcome",
    [
        ([9, 11, 9, 9], [("above", "failed_breakout")]),
        ([9, 11, 11, 9], [("above", None)]),
        ([11, 9, 11, 11], [("below", "failed_breakout")]),
        ([11, 9, 9, 11, 11], [("below", "successful_reclaim")]),
        ([11, 9, 9, 11, 9, 11], [("below", None)]),
        ([9, 11], [("above", None)]),
        ([9, 9, 9], []),
        ([10, 11, 10], [("above", "failed_breakout")]),
    ],
)
def test_level_outcomes(spark, closes, outcome):
    bars = spark.createDataFrame([("a", k, float(c)) for k, c in enumerate(closes)], "symbol string, t long, c double")
    levels = spark.createDataFrame([("a", 10.0)], "symbol string, level double")
    assert [(r.side, r.outcome) for r in rules.level_resolutions(bars, levels).collect()] == outcome


def test_records_without_times_or_rows(spark):
    empty = spark.createDataFrame([], RECORD)
    assert integrity.issues(empty, 5).count() == integrity.report(empty, 5).count() == 0
    blank = spark.createDataFrame([("a", 0, None, None, None, None, None, None)], RECORD)
    row = integrity.report(blank, 5).first()
    assert (row.ok, row.expected_slots, row.observed_count, row.unique_open_times, row.kinds) == (False, 0, 1, 0, "gap,ohlc_violation")
    inside = spark.createDataFrame([("a", 0, 310, 1.0, 1.0, 1.0, 1.0, 0.0), ("a", 1, 320, 1.0, 1.0, 1.0, 1.0, 0.0)], RECORD)
    assert integrity.report(inside, 5).first().expected_slots == 0 and integrity.gaps(inside, 5).count() == 0


def test_gaps_snap_to_the_grid(spark):
    rows = [("a", k, t, 1.0, 1.0, 1.0, 1.0, 0.0) for k, t in enumerate((10, 600, 900, 1810))]
    records = spark.createDataFrame(rows, RECORD)
    assert sorted(r.t for r in integrity.gaps(records, 5).collect()) == [300, 1200, 1500, 1800]


def test_series_of_several_timeframes_are_refused(spark):
    rows = spark.createDataFrame([("a", 0, 0, "5m", 1.0), ("a", 1, 0, "1h", 2.0)], "symbol string, i long, t long, timeframe string, c double")
    with pytest.raises(integrity.MixedTimeframes):
        integrity.last_prints(rows)
    assert integrity.last_prints(rows.drop("timeframe")).first().c == 2.0


def _bars(spark, n=40):
    return spark.createDataFrame([("a", 300 * k, 1.0, 1.0, 1.0, 10.0 + (k % 7) / 10, 1.0) for k in range(n)], "symbol string, t long, o double, h double, l double, c double, v double")


def test_catch_up_in_rounds_reaches_every_origin(spark):
    bars, done = _bars(spark), spark.createDataFrame([], "symbol string, forecasted_at long")
    for left in (3, 0):
        made = journal.catch_up(bars, done, 5, budget=7).collect()
        assert {r.remaining for r in made} == {left}
        done = done.unionByName(spark.createDataFrame([(r.symbol, r.forecasted_at) for r in made], done.schema))
    assert sorted(r.forecasted_at for r in done.collect()) == [300 * (k + 1) for k in range(20, 30)]
    assert journal.catch_up(bars, done, 5, budget=7).count() == 0
    assert journal.catch_up(_bars(spark, 30), done.limit(0), 5).count() == 0


def test_outcomes_are_written_once_and_never_early(spark):
    bars = _bars(spark)
    made = spark.createDataFrame([("a", "f", 300 * 36, 10.0), ("a", "g", 301, 10.0), ("a", "z", 600, 0.0)], "symbol string, forecast_id string, forecasted_at long, origin_close double")
    got = journal.matured(made, bars, 5, 300 * 38)
    assert sorted((r.forecast_id, r.h, r.matured_at) for r in got.collect()) == [("f", 1, 300 * 37), ("f", 2, 300 * 38)]
    assert math.isclose(got.where("h = 1").first().realized, math.log((10 + (36 % 7) / 10) / 10))
    later = journal.matured(made, bars, 5, stored=got)
    assert sorted(r.h for r in later.collect()) == [3, 4]


def test_horizons_are_inspected(spark):
    kinds = "symbol string, forecast_id string, i int, h int, p double, q10 double, q50 double, q90 double, expected double"
    rows = [("a", "f", k, k, 0.5, -0.1, 0.0, 0.1, 0.0) for k in range(1, 9)] + [("a", "f", 9, 1, 0.5, -0.1, 0.0, 0.1, 0.0), ("a", "f", 10, 9, 2.0, 0.2, 0.0, 0.1, math.nan), ("a", "f", 11, 12, 0.5, 0.0, 0.0, 0.0, 0.0)]
    got = {r.h: (r.status, r.issues) for r in journal.inspected(spark.createDataFrame(rows, kinds)).collect()}
    assert got[2] == ("ok", []) and got[1] == ("rejected", ["duplicate-horizon"]) and got[10] == ("missing", ["missing-horizon"]) and got[12] == ("rejected", ["horizon-out-of-range"])
    assert got[9] == ("rejected", ["crossed-quantiles", "non-finite-expected", "probability-out-of-range"]) and len(got) == 11


def test_nothing_is_carried_over_a_gap(spark):
    price = lambda s, k: 10.0 + len(s) + ((k * (3 + len(s))) % 11) / 10
    rows = [(s, 300 * k, price(s, k)) for s in ("f", "one", "second") for k in range(12) if (s, k) != ("one", 6)]
    got = {r.t // 300: r for r in cross_market(spark.createDataFrame(rows, "symbol string, t long, c double"), "one", "second", 5, window=3).collect()}
    assert got[0].evidence[0] == "missing_prior_aligned_candle" and got[6].evidence == ["missing_aligned_candle", "btc_not_aligned_at_eval"]
    assert got[6].health == got[7].health == "unknown" and got[9].regime == "unknown" and got[7].first_move == "unknown" and got[7].decoupled is None
    assert [got[k].first_health for k in (3, 5, 8, 9, 10)] == ["valid", "valid", "degraded", "degraded", "valid"]
    assert got[10].volatility == "unknown" and "btc_vol_no_baseline" in got[10].evidence
    x = [math.log(price("f", k) / price("f", k - 1)) for k in (3, 4, 5)]
    y = [math.log(price("one", k) / price("one", k - 1)) for k in (3, 4, 5)]
    mx, my = sum(x) / 3, sum(y) / 3
    assert math.isclose(got[5].first_beta, sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((b - my) ** 2 for b in y))
    with pytest.raises(ValueError):
        cross_market(spark.createDataFrame(rows, "symbol string, t long, c double"), "one", "second", 5, window=2)
