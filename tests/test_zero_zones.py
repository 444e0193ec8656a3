"""Zones about a price of 0, and ids of halfway edges, against their SQL."""

import pytest
from oracle import differences

from tidebar.operators.swings import zone_ids
from tidebar.queries import ORACLES, QUERIES

#: Lows at 0 (a), lows and highs on both sides of 0 (b), lows at and near 0 (c); one event for each bar of four hours.
VALUES = {"a": [5, 7, 0, 6, 8, 7, 6, 0, 9, 5], "b": [3, 0.004, -0.004, -3, -5, 0, 4, 1, -2, 2], "c": [2, 3, 0, 4, 5, 3, 0.01, 4, 6, 5]}


@pytest.fixture(scope="module")
def zero_dir(tmp_path_factory):
    import duckdb

    d = tmp_path_factory.mktemp("zero")
    rows = [(100 * k + i, 14400 * k, s, float(v[(k + i) % 10])) for i, (s, v) in enumerate(VALUES.items()) for k in range(60)]
    con = duckdb.connect()
    con.execute("create table e (event_id bigint, seconds bigint, event_type varchar, value double)")
    con.executemany("insert into e values (?, ?, ?, ?)", rows)
    con.execute(f"copy (select event_id, timestamp '2024-01-01' + to_seconds(seconds) as ts, event_type, value from e) to '{d}/events.parquet'")
    return str(d)


def test_specs_about_zero(spark, zero_dir):
    found = QUERIES["p8_specs_at_formation"](spark, zero_dir)
    assert found.where("lower = 0 and upper = 0").count()
    assert differences(found, zero_dir, ORACLES["p8_specs_at_formation"]) == []


def test_tracked_zones_about_zero(spark, zero_dir):
    found = QUERIES["p14_tracked_zones"](spark, zero_dir)
    assert found.where("lower = 0 and upper = 0").count()
    assert differences(found, zero_dir, ORACLES["p14_tracked_zones"]) == []


def test_ids_of_edges_halfway_between_eight_places(spark):
    import duckdb

    edges = [1.5e-8, -5e-9, 1.25e-7, 222.285452315, 12.345678905, 490.388032815, 0.0]
    zones = spark.createDataFrame([(x, x + 1, "support") for x in edges], "lower double, upper double, role string")
    sql = "select substring(sha1(printf('%.8f:%.8f:%s', x, x + 1, 'support')), 1, 12) from (select unnest(?::double[]) as x)"
    want = [r[0] for r in duckdb.execute(sql, [edges]).fetchall()]
    assert sorted(r.zone_id for r in zone_ids(zones).collect()) == sorted(want)


def test_roles_by_bars_without_a_close(spark):
    from tidebar.operators.clusters import specs_at_formation

    pivots = spark.createDataFrame([("a", 0, 2, 10.0, "high"), ("a", 0, 3, 20.0, "high"), ("a", 0, -1, 30.0, "high")], "symbol string, t long, known_t long, price double, kind string")
    bars = spark.createDataFrame([("a", 0, 15.0), ("a", 2, None), ("a", 3, 15.0)], "symbol string, t long, c double")
    assert sorted((r.known_t, r.role) for r in specs_at_formation(pivots, bars).collect()) == [(-1, "resistance"), (2, "mixed"), (3, "resistance")]
