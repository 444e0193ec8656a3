"""Canonical JSON against the standard library's, byte for byte."""

import hashlib
import json
import random
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidebar.functions.canonical import canonical, content_hash, iso, number
from tidebar.operators.integrity import manifest, payloads
from tidebar.sources.fixture import breakout_bars


def dump(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), allow_nan=False)


def test_numbers(spark):
    r = random.Random(4)
    values = [0.0, -0.0, 1.0, 100.0, 0.1, 1e-4, 9.999e-5, 1e15, 1e16, 123456789012345680.0, 1.5e300, 5e-324, 2e-323, 2.2250738585072014e-308, 1.7976931348623157e308, 2e23, 8.41e21, 2.0e-3, 9007199254740993.0, -7.1873198480000005, 0.30000000000000004, 8.191999999999998, 1 / 3, 2.5e-7]
    values += [struct.unpack("<d", r.getrandbits(64).to_bytes(8, "little"))[0] for _ in range(20000)] + [r.uniform(-10, 10) for _ in range(5000)] + [round(r.uniform(0, 1e6), r.randint(0, 6)) for _ in range(5000)]
    values = [v for v in values if v == v and abs(v) != float("inf")]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", number(F.col("v")).alias("s")).collect()
    # of two shortest texts of 17 digits the runtime may have picked the farther one: both are read back as the number
    assert [(x.v, x.s) for x in rows if float(x.s) != x.v or len(x.s) != len(repr(x.v))] == []
    wrong = [(x.v, x.s) for x in rows if x.s != repr(x.v)]
    assert len(wrong) <= 3 and all(not 1e-9 < abs(v) < 1e15 for v, _ in wrong)
    for bad in ("NaN", "Infinity"):
        with pytest.raises(PySparkException):
            spark.sql(f"select double('{bad}') as v").select(number(F.col("v"))).collect()


def test_nested_rows(spark):
    kind = "row struct<b: bigint, a: string, z: struct<y: array<double>, x: boolean>, m: map<string, array<struct<k: int, j: string>>>, _hidden: int, content_hash: string>"
    rows = [
        {"b": 1, "a": 'quote " slash \\ / \x00\x1f\x7f\b\f\n\r\t é 漢 \U0001f600  ', "z": {"y": [1.5, None, -0.0, 1e-7], "x": True}, "m": {"b": [{"k": 1, "j": "x"}], "a": [], "Z": None}, "_hidden": 3, "content_hash": "x"},
        {"b": None, "a": "", "z": None, "m": {}, "_hidden": None, "content_hash": None},
        {"b": -5, "a": "plain", "z": {"y": [], "x": None}, "m": None, "_hidden": 1, "content_hash": "y"},
    ]
    df = spark.createDataFrame([(r,) for r in rows], kind)
    inner = df.schema["row"].dataType
    assert isinstance(inner, StructType)
    out = df.select(canonical(F.col("row"), inner).alias("j"), content_hash(F.col("row"), inner).alias("h")).collect()
    for r, x in zip(rows, out, strict=True):
        assert x.j == dump(r)
        assert x.h == "sha256:" + hashlib.sha256(dump({k: v for k, v in r.items() if k not in ("_hidden", "content_hash")}).encode()).hexdigest()
    none = spark.createDataFrame([(None,)], kind)
    assert none.select(canonical(F.col("row"), inner)).first()[0] == "null"


def sealed_rows():
    """The breakout fixture with its prices added up one after another, as the sealed file has them (breakout_bars() multiplies, and differs in last digits)."""
    out, price = [], 7.20

    def bar(price, high=None, low=None):
        i = len(out)
        o = price * (1.0002 if i % 2 == 0 else 0.9998)
        out.append((1787184000 + 300 * i, o, max(o, price) + 0.012 if high is None else high, min(o, price) - 0.012 if low is None else low, price, float(1000 + i)))

    for _ in range(8 * 288):
        price = min(8.06, price + 0.00038)
        bar(price)
    for n in range(2 * 288):
        price = 8.02 - 0.00015 * n
        bar(price, min(8.22, 8.12 + (n % 7) * 0.012), price - 0.03)
    for n in range(3 * 288):
        price = max(7.28, 7.95 - 0.00075 * n)
        bar(price)
    last = price
    for n in range(24):
        bar(last + 0.012 * n)
    return out


def test_the_sealed_fixture_is_reproduced(spark):
    """The published SHA-256 of the fixture's JSON lines."""
    bars = spark.createDataFrame(sealed_rows(), "t long, o double, h double, l double, c double, v double")
    rows = bars.select("t", F.struct(F.lit("AVAXUSDT").alias("symbol"), F.lit("5m").alias("timeframe"), iso(F.col("t")).alias("open_time"), iso(F.col("t") + 300).alias("close_time"), F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"), F.col("v").cast("long").alias("volume"), F.lit(True).alias("is_closed")).alias("r"))
    lines = [x.j for x in rows.select("t", canonical(F.col("r"), rows.schema["r"].dataType).alias("j")).orderBy("t").collect()]
    assert lines[0].startswith('{"close":7.20038,"close_time":"2026-08-20T00:05:00+00:00"')
    assert hashlib.sha256(("\n".join(lines) + "\n").encode()).hexdigest() == "3f791fcdb51b3b9823701320a89275b2ec75836536567409523289fb6544fb8e"


def test_manifest_hashes_all_rows_in_order(spark):
    bars = breakout_bars(spark).repartition(7)
    lines = [x.payload for x in payloads(bars, "5m").orderBy("t").collect()]
    (row,) = manifest(bars, "5m").collect()
    assert (row.bars, row.sha256) == (3768, hashlib.sha256("".join(x + "\n" for x in lines).encode()).hexdigest())
    with pytest.raises(ValueError, match="no bars"):
        manifest(bars.limit(0))
