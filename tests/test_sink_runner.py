"""The sink that takes every batch once, and the runner of any predictor."""

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_carried import frame, walk

from tidebar.operators import ridge, sink
from tidebar.operators.runner import rolling_folds, walk_folds
from tidebar.operators.store import ImmutableConflict

ROWS = "symbol string, t long, c double, is_closed boolean"
STORED = "symbol string, t long, c double"


def rows(spark, *triples):
    return spark.createDataFrame([(*x, True) for x in triples], ROWS)


def stored(spark, path, **options):
    return sorted(map(tuple, sink.load(spark, path, STORED, **options).collect()))


def test_a_batch_is_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    one = rows(spark, ("a", 1, 1.0), ("a", 2, 2.0), ("a", 2, 2.0))
    assert sink.append(path, one, ["symbol", "t"], "s:0") == 2
    assert sink.append(path, one, ["symbol", "t"], "s:0") == 0
    # the same rows in another batch are no change; new ones are added, open ones are not
    more = one.unionByName(rows(spark, ("b", 1, 3.0))).unionByName(spark.createDataFrame([("c", 1, 9.0, False)], ROWS))
    assert sink.append(path, more, ["symbol", "t"], "s:1") == 1
    with pytest.raises(ImmutableConflict):
        sink.append(path, rows(spark, ("d", 1, 1.0), ("a", 1, 7.0)), ["symbol", "t"], "s:2")
    assert stored(spark, path) == [("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)]
    assert stored(spark, path, upto=0) == [("a", 1, 1.0), ("a", 2, 2.0)]
    assert [(c["number"], c["batch"], c["rows"]) for c in sink.commits(spark, path)] == [(0, "s:0", 2), (1, "s:1", 1)]
    # a writer that died before its record left a folder that no reader sees
    rows(spark, ("x", 1, 1.0)).drop("is_closed").write.parquet(f"{path}/data/part-dead")
    assert len(stored(spark, path)) == 3 and sink.vacuum(spark, path) == ["part-dead"] and len(stored(spark, path)) == 3


def test_batches_at_once(spark, tmp_path):
    """Four writers of one batch, and of others that share keys with it; one more contradicts them."""
    path, results = f"file://{tmp_path}/table", {}

    def write(name, batch, df):
        try:
            results[name] = sink.append(path, df, ["symbol", "t"], batch)
        except ImmutableConflict:
            results[name] = "refused"

    shared = [("a", t, float(t)) for t in range(20)]
    jobs = [(f"same{i}", "s:0", rows(spark, *shared)) for i in range(2)] + [(f"other{i}", f"s:{i}", rows(spark, *shared, ("b", i, 1.0))) for i in (1, 2)]
    jobs.append(("against", "s:9", rows(spark, ("a", 3, -1.0))))
    threads = [threading.Thread(target=write, args=j) for j in jobs]
    [t.start() for t in threads]
    [t.join(200) for t in threads]
    assert len(results) == 5
    found = stored(spark, path)
    assert len({x[:2] for x in found}) == len(found)
    assert {("b", 1, 1.0), ("b", 2, 1.0)} <= set(found)
    a = {t: c for s, t, c in found if s == "a"}
    if results["against"] == "refused":
        assert a == {t: float(t) for t in range(20)} and results["same0"] + results["same1"] + results["other1"] + results["other2"] == 22
    else:
        assert a[3] == -1.0
    assert [c["number"] for c in sink.commits(spark, path)] == list(range(len(sink.commits(spark, path))))


def test_a_stream_that_replays_a_batch(spark, tmp_path):
    """A query restarted without its checkpoint sends its batches again, under the same ids."""
    path = f"file://{tmp_path}/table"
    for k in range(3):
        rows(spark, ("a", k, float(k))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for run in range(2):
        source = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = source.writeStream.foreachBatch(sink.batch_writer(path, ["symbol", "t"], "bars")).option("checkpointLocation", str(tmp_path / f"ck{run}")).trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None
    assert stored(spark, path) == [("a", k, float(k)) for k in range(3)]
    assert [c["batch"] for c in sink.commits(spark, path)] == ["bars:0", "bars:1", "bars:2"]


@pytest.mark.parametrize("cell", [64, 2048])
def test_runner_gives_the_ridge_scores(spark, cell):
    bars = frame(spark, {"a": walk(71, 500), "b": walk(72, 200)})
    want = {(r.symbol, r.h): r for r in ridge.walk_forward(bars, first=120, step=20, lookback=150).collect()}
    table = ridge.horizon_rows(bars).where("y is not null").groupBy("symbol", "n", "drift", "r1", "r3").agg(F.map_from_entries(F.collect_list(F.struct("h", "y"))).alias("y"))
    table = table.select("symbol", "n", "drift", "r1", "r3", *[F.col("y")[h].alias(f"y{h}") for h in range(1, 11)])

    def fit(train: pd.DataFrame, test: pd.DataFrame) -> pd.DataFrame:
        out = []
        for h in range(1, 11):
            own, one = train.dropna(subset=["r1", "r3", f"y{h}"]), test.dropna(subset=["r1", "r3", f"y{h}"])
            if len(own) < 30 or not len(one):
                continue
            z = np.column_stack([np.ones(len(own)), own["r1"], own["r3"]])
            w = np.linalg.solve(z.T @ z + 8.0 * np.diag([0.0, 1.0, 1.0]), z.T @ own[f"y{h}"].to_numpy())
            out.append((h, float(one[f"y{h}"].iloc[0]), float(np.array([1.0, one["r1"].iloc[0], one["r3"].iloc[0]]) @ w)))
        return pd.DataFrame(out, columns=["h", "y", "p"])

    found = walk_folds(table, rolling_folds(table, 120, 20, 150, 10), fit, "h int, y double, p double", cell)
    got = {(r.symbol, r.h): r for r in found.groupBy("symbol", "h").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae")).collect()}
    assert got.keys() == want.keys() and len(got) == 20
    for k, w in want.items():
        assert got[k].n == w.n and got[k].mae == pytest.approx(w.ridge_mae, rel=1e-9)
