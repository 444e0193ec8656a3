import pytest

from tidebar.operators.features import feature_history, feature_names
from tidebar.operators.resample import visible
from tidebar.operators.store import ImmutableConflict, append
from tidebar.sources.bars import bars_from_events


def test_append_is_idempotent_and_refuses_changes(spark, tmp_path):
    path, kinds = str(tmp_path / "t"), "symbol string, t long, c double"
    append(path, spark.createDataFrame([("a", 1, 1.0)], kinds), ["symbol", "t"])
    append(path, spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0)], kinds), ["symbol", "t"])
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ImmutableConflict):
        append(path, spark.createDataFrame([("a", 1, 3.0)], kinds), ["symbol", "t"])


def test_feature_prefixes_agree(spark):
    bars = bars_from_events(spark, "/root/testdata/sf0.001", 60)
    cut = 1705276800
    history = lambda b: feature_history(b, 60, {"4h": 240}, {"btc": "click", "eth": "view"}, ["click", "purchase"])
    full = history(bars).where(f"t <= {cut - 3600}")
    prefix = history(visible(bars, 60, cut))
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert key(full) == key(prefix)


def test_the_schema_has_179_names():
    names = feature_names()
    assert len(names) == len(set(names)) == 179
    assert names[0] == "avax_5m_logret_1" and names[-1] == "rel_sync_eth_1" and "avax_1d_ema200_slope" in names


def test_values_are_compared_and_not_their_hashes(spark, tmp_path):
    path, kinds = str(tmp_path / "n"), "symbol string, t long, c double"
    append(path, spark.createDataFrame([("a", 1, None)], kinds), ["symbol", "t"])
    append(path, spark.createDataFrame([("a", 1, None)], kinds), ["symbol", "t"])
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(ImmutableConflict):
        append(path, spark.createDataFrame([("a", 1, 0.0)], kinds), ["symbol", "t"])


def test_bars_do_not_follow_the_session_zone(spark):
    want = sorted(map(tuple, bars_from_events(spark, "/root/testdata/sf0.001").collect()))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        assert sorted(map(tuple, bars_from_events(spark, "/root/testdata/sf0.001").collect())) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_zones_use_the_series_average_range(spark):
    from tidebar.operators.zones import Zone, zone_events

    rows = [("a", k, 10.0, 11.0 + k % 3, 9.0 - k % 2, 10.0 + (k % 5) / 4, 1.0) for k in range(40)]
    bars = spark.createDataFrame(rows, "symbol string, t long, o double, h double, l double, c double, v double")
    zones = spark.createDataFrame([("a", "z", 10.4, 10.8, "resistance", 25)], "symbol string, zone_id string, lower double, upper double, role string, known_t long")
    from tidebar.operators.recurrences import atr
    import numpy as np

    h, l, c = (np.array([r[k] for r in rows]) for k in (3, 4, 5))  # noqa: E741
    zone, want = Zone("z", 10.4, 10.8, "resistance"), [(25, "approaching", 0)]
    zone.open(c[25])
    for k in range(25, 40):
        if zone.step(h[k], l[k], c[k], atr(h, l, c)[k]):
            want.append((k, zone.state, zone.tests))
    assert sorted((r.t, r.state, r.tests) for r in zone_events(bars, zones).collect()) == sorted(want)
