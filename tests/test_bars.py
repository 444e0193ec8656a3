import numpy as np
import pytest
from oracle import differences
from pyspark.sql import functions as F

from tidebar.operators.recurrences import atr, ema, rsi
from tidebar.operators.resample import resample, visible
from tidebar.operators.zones import Zone, zigzag, zigzag_pivots
from tidebar.queries import ORACLES, QUERIES
from tidebar.sources.bars import bars_from_events

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), SF, ORACLES[name]) == []


def test_incomplete_buckets_are_dropped(spark):
    rows = [("a", 3600 * k, 1.0, 2.0, 0.5, 1.5, 1.0) for k in (0, 1, 2, 3, 4, 5, 6)]
    out = resample(spark.createDataFrame(rows, "symbol string, t long, o double, h double, l double, c double, v double"), 60, 240)
    assert [(r.t, r.v) for r in out.collect()] == [(0, 4.0)]


def test_later_bars_change_nothing_before(spark):
    bars = bars_from_events(spark, SF)
    cut = 1705276800
    past = visible(bars, 240, cut)
    poisoned = past.unionByName(bars.where(F.col("t") > cut - 14400).withColumn("c", F.col("c") * 50))
    name = "k4_realized_vol"
    from tidebar.plans.bar_plans import spark_sql

    a = spark.sql(spark_sql(name), bars=past).collect()
    b = spark.sql(spark_sql(name), bars=poisoned).where(F.col("t") <= cut - 14400).collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)


def test_recurrences():
    x = np.array([1.0, 2.0, 3.0])
    assert ema(x, 3).tolist() == [1.0, 1.5, 2.25]
    assert np.isnan(rsi(np.ones(14))).all() and rsi(np.ones(15))[-1] == 100
    assert atr(x + 1, x, x, 2)[1] == 1.5


def test_zigzag_prefixes_agree():
    rng = np.random.default_rng(3)
    c = 10 + np.cumsum(rng.normal(size=200))
    h, l = c + 0.1, c - 0.1  # noqa: E741
    full = zigzag(c, h, l, 2 * atr(h, l, c))
    for cut in (50, 120, 180):
        assert zigzag(c[:cut], h[:cut], l[:cut], 2 * atr(h[:cut], l[:cut], c[:cut])) == [p for p in full if p[1] < cut]


def test_zone_accepts_after_two_closes_and_a_wick_never_does():
    z = Zone("z", 10.0, 11.0, "resistance")
    z.step(12.0, 9.0, 9.5, 5.0)
    assert z.state == "testing" and z.tests == 1
    z.step(11.6, 10.5, 11.5, 5.0)
    assert z.state == "penetrated"
    z.step(11.6, 11.1, 11.5, 5.0)
    assert z.state == "accepted"


def test_zigzag_pivots_are_known_no_earlier(spark):
    assert all(r.known_t >= r.t for r in zigzag_pivots(bars_from_events(spark, SF)).collect())


def test_stream_equals_batch(spark, tmp_path):
    from tidebar.streaming.bars import closed_bars

    events = spark.read.parquet(f"{SF}/events.parquet")
    far = events.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp_ntz"))
    for k, df in enumerate((events.coalesce(1), far)):
        df.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = closed_bars(stream, 240).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.symbol, r.t): (r.o, r.c, r.v) for r in spark.table("closed").collect()}
    want = {(r.symbol, r.t): (r.o, r.c, r.v) for r in bars_from_events(spark, SF).collect()}
    assert got == want
