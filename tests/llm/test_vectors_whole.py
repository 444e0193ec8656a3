"""Vectors of every length link."""

import numpy as np
import pandas as pd

from tidebar.llm import embedding_dedup


def test_vectors_of_every_length_link(spark):
    rng = np.random.default_rng(2)
    base = {d: rng.normal(size=(300, d)) for d in (8, 12, 5)}
    rows, n = [], 0
    for d, count in ((8, 900), (12, 600), (5, 40)):
        for k in range(count):
            rows.append((n, (base[d][k % 300] + 0.02 * rng.normal(size=d)).tolist(), k % 300 % 2))
            n += 1
    out = {r.vec_id: r for r in embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), recall=1.0, block=64).collect()}
    by = pd.DataFrame(rows, columns=["id", "v", "label"])
    by["d"] = by["v"].map(len)
    for _, part in by.groupby(["d", "label"]):
        x = np.array(part["v"].to_list())
        x /= np.linalg.norm(x, axis=1)[:, None]
        assert [out[i].n_links for i in part["id"]] == ((x @ x.T >= 0.93).sum(1) - 1).tolist()


def _brute(rows, cosine=0.93):
    """n_links and component_id by vec_id; rows are (vec_id, vector, label)."""
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows])
    x = x / np.abs(x).max(1)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= cosine) & (label[:, None] == label[None])
    root = np.array(ids)
    for _ in ids:
        root = np.where(near, root[None], 1 << 60).min(1)
    return dict(zip(ids, zip((near.sum(1) - 1).tolist(), root.tolist(), strict=True), strict=True))


def test_many_cells_equal_vectors_and_extreme_sizes(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    rows = []
    for k in range(1500):
        v = base[k % 300] + 0.1 * rng.normal(size=16)
        rows.append((k + 1, (v * [1.0, 1e200, 1e-200][k % 3]).tolist(), "ab"[k % 2]))
    rows += [(10_000 + k, base[3].tolist(), "a") for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    out = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_links(df, recall=1.0, block=64).collect()}
    want = _brute(rows)
    assert len(out) == len(rows)
    # the bound for all partners is fitted on a sample: nearly all rows agree, and no row has a link too many
    assert all(out[k][0] <= want[k][0] for k in want)
    assert sum(out[k] == want[k] for k in want) >= 0.99 * len(want)


def test_rows_that_repeat_a_vec_id(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 1.0], 1), (3, [0.0, 2.0], 1), (3, None, 1), (None, [0.0, 1.0], 1)]
    out = sorted((tuple(r) for r in embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=str)
    assert out == sorted([(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (None, 0, None, True)], key=str)
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert embedding_dedup.embedding_links(none).count() == 0


def test_visits_are_the_cells_up_to_the_limit():
    rng = np.random.default_rng(6)
    index = embedding_dedup.Index(embedding_dedup.unit(rng.normal(size=(600, 8))), 100, 0.93, 0.99)
    x = embedding_dedup.unit(rng.normal(size=(20, 8)))
    for b1, b2 in zip(*index.bounds(x), strict=True):
        total = b1[:, None] ** 2 + b2[None] ** 2
        seen = index.visits(b1, b2)
        assert sorted(seen.tolist()) == np.flatnonzero(total.ravel() <= index.limit).tolist()
        assert (np.diff(total.ravel()[seen]) >= 0).all()
