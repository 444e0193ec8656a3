"""Near-duplicate vectors by an inverted multi-index.

Each half of the vectors has its own codebook; their product is a grid of cells, and every valid vector
is filed under its cell. A vector visits cells in the order of the least distance that a partner there can have
(by the planes between centres, both halves together) until the target recall: the bound
is taken from a bounded sample, moved at random to just the threshold's cosine, so that ``recall`` of such
partners are met. A pair is met if either side visits the other's cell, and every met pair is
verified by its cosine in double precision. Equal vectors of a label are one entry that counts as often as it stands. Vectors of each length have their own codebooks and bound, and meet
their own length alone; lengths of at most ``SINGLE`` vectors have one cell, where all pairs meet.

Large cells are dealt out as pairs of blocks; a block pair returns counts and the links of a
spanning forest, never its pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with
nothing; vectors are scaled by their largest component first, so very large and very small ones link too; rows that repeat a vec_id count as one
vector, of different ones the least (label, vector) that can link; labels of any type are compared as they are; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, small
from .components import components

COSINE, SAMPLE, RECALL, BLOCK, SINGLE = 0.93, 4_000, 0.995, 256, 512


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = _squares(x, c).argmin(1)
        for i in range(len(c)):
            if (own := near == i).any():
                c[i] = x[own].mean(0)
    return np.unique(c, axis=0)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0)


class Index:
    """The two codebooks and the bound up to which cells are visited."""

    def __init__(self, sample: np.ndarray, cells: int, cosine: float, recall: float):
        self.half = sample.shape[1] // 2 or 1
        k = max(2, int(cells**0.5))
        self.books = [_centres(sample[:, : self.half], k), _centres(sample[:, self.half :], k) if sample.shape[1] > 1 else np.zeros((1, 0))]
        self.gaps = [np.sqrt(_squares(c, c)) + np.eye(len(c)) for c in self.books]
        rng = np.random.default_rng(7)
        side = rng.normal(size=sample.shape)
        side -= (side * sample).sum(1)[:, None] * sample
        side /= np.maximum(np.linalg.norm(side, axis=1), 1e-12)[:, None]
        moved = cosine * sample + (1 - cosine**2) ** 0.5 * side
        there, back = self.bounds(sample), self.bounds(moved)
        home, other = self.home(sample), self.home(moved)
        rows = np.arange(len(sample))
        need = np.minimum(*[b[0][rows, h[0]] ** 2 + b[1][rows, h[1]] ** 2 for b, h in ((there, other), (back, home))])
        self.limit = float(np.quantile(need, recall))

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def home(self, x: np.ndarray) -> list[np.ndarray]:
        return [_squares(p, c).argmin(1) for p, c in zip(self.parts(x), self.books, strict=True)]

    def bounds(self, x: np.ndarray) -> list[np.ndarray]:
        """For each half the least distance from each vector to each centre's region."""
        out = []
        for p, c, gap in zip(self.parts(x), self.books, self.gaps, strict=True):
            d = _squares(p, c)
            near = d.argmin(1)
            out.append(np.maximum(d - d[np.arange(len(d)), near][:, None], 0) / (2 * gap[near]))
        return out

    def cell(self, i, j):
        return i * len(self.books[1]) + j

    def visits(self, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
        """One vector's cells, nearest first, up to the limit: both sequences in order, and for each step along the first
        the stretch of the second that the limit leaves, so that no other cell of the grid is looked at."""
        i, j = np.argsort(b1, kind="stable"), np.argsort(b2, kind="stable")
        s, t = b1[i] ** 2, b2[j] ** 2
        upto = np.searchsorted(t, self.limit - s, side="right")
        step = np.repeat(np.arange(len(s)), upto)
        other = np.arange(len(step)) - np.repeat(np.cumsum(upto) - upto, upto)
        order = np.argsort(s[step] + t[other], kind="stable")
        return self.cell(i[step[order]], j[other[order]])


def _of(indexes: dict[int, Index], dim: int) -> Index:
    """The length's index; one cell where it has too few vectors for one."""
    if dim not in indexes:
        indexes[dim] = Index(np.zeros((1, dim)), 1, COSINE, RECALL)
    return indexes[dim]


def _filed(shared):
    def run(batches):
        for batch in batches:
            for dim, pdf in batch.groupby("dim"):
                index = _of(shared.value, dim)
                x = unit(np.stack(pdf["v"].to_list()).astype(np.float64))
                h = index.home(x)
                home, (b1, b2) = index.cell(*h), index.bounds(x)
                rows = []
                for k, (d, label, times) in enumerate(zip(pdf["id"], pdf["label"], pdf["times"], strict=True)):
                    seen = index.visits(b1[k], b2[k])
                    rows.append((d, label, times, dim, x[k].tobytes(), int(home[k]), [int(c) for c in seen if c != home[k]]))
                yield pd.DataFrame(rows, columns=["id", "label", "times", "dim", "v", "home", "visits"])

    return run


def _blocks(shared, cosine: float):
    def run(key, pdf):
        index, cell = _of(shared.value, key[1]), key[2]
        m, p = pdf[pdf["member"]], pdf[~pdf["member"]]
        if not len(m) or not len(p):
            return pd.DataFrame({"id": [], "n": [], "to": []})
        y, x = (np.frombuffer(b"".join(q["v"]), np.float64).reshape(len(q), -1) for q in (m, p))
        yi, xi = m["id"].to_numpy(), p["id"].to_numpy()
        near = (x @ y.T >= cosine) & (xi[:, None] != yi[None, :])
        if not near.any():
            return pd.DataFrame({"id": [], "n": [], "to": []})
        # members probe each other from both sides; a visitor's pair counts for the member too unless the member visits the visitor's cell
        home = p["home"].to_numpy()
        b1, b2 = index.bounds(y)
        back = (b1[:, home // len(index.books[1])] ** 2 + b2[:, home % len(index.books[1])] ** 2).T <= index.limit
        n_x = near @ m["times"].to_numpy()
        n_y = p["times"].to_numpy() @ (near & ~back & (home != cell)[:, None])
        ids, at = np.unique(np.concatenate([xi, yi]), return_inverse=True)
        ax, ay = at[: len(xi)], at[len(xi) :]
        root, big = np.arange(len(ids)), len(ids)
        while True:
            new = root.copy()
            np.minimum.at(new, ax, np.where(near, root[ay][None, :], big).min(1, initial=big))
            np.minimum.at(new, ay, np.where(near, root[ax][:, None], big).min(0, initial=big))
            new = new[new]
            if (new == root).all():
                break
            root = new
        counts = np.zeros(len(ids), dtype=np.int64)
        np.add.at(counts, ax, n_x)
        np.add.at(counts, ay, n_y)
        own = (counts > 0) | (root != np.arange(len(ids)))
        return pd.DataFrame({"id": ids[own], "n": counts[own], "to": ids[root[own]]})

    return run


def embedding_links(embeddings: DataFrame, cosine: float = COSINE, recall: float = RECALL, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = rows.where(F.col("label").isNotNull() & F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    all_ids = rows.select(F.col("id").alias("vec_id")).distinct()
    twice = durable(valid.groupBy("id").count().where("count > 1").select("id"))
    if not twice.isEmpty():
        one = valid.join(small(twice), "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.*")
        valid = valid.join(small(twice), "id", "left_anti").unionByName(one)
    # equal vectors by 128 bits of hash, length and label
    keyed = valid.select("id", "label", F.size("v").alias("dim"), F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(7), "v", F.lit(11)).alias("k2"), "v")
    equal = ["label", "dim", "k1", "k2"]
    valid = durable(keyed.groupBy(*equal).agg(F.min("id").alias("id"), F.count("*").alias("times"), F.first("v").alias("v")))
    members = keyed.select("id", *equal).join(valid.select(F.col("id").alias("rep"), "times", *equal), equal).select("id", "rep", "times")
    sizes = {r["dim"]: r["count"] for r in valid.groupBy("dim").count().collect()}
    if not sizes:
        return all_ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    indexes = {}
    for dim, n in sorted(sizes.items()):
        if n > SINGLE:
            # the grid grows with the vectors, its sides and their sample by the square root
            cells = max(4, n // 512)
            drawn = valid.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").select("v").limit(max(sample, 8 * int(cells**0.5))).collect()
            indexes[dim] = Index(unit(np.array([r["v"] for r in drawn])), cells=cells, cosine=cosine, recall=recall)
    shared = spark.sparkContext.broadcast(indexes)
    filed = durable(valid.mapInPandas(_filed(shared), "id long, label string, times long, dim int, v binary, home int, visits array<int>"))

    homes = filed.groupBy("label", "dim", F.col("home").alias("cell")).agg(F.count("*").alias("nm"))
    seen = filed.select("label", "dim", F.explode(F.concat(F.array("home"), "visits")).alias("cell"), "id", "home")
    loads = durable(seen.groupBy("label", "dim", "cell").agg(F.count("*").alias("np")).join(homes, ["label", "dim", "cell"]))
    loads = loads.select("label", "dim", "cell", F.ceil(F.col("nm") / block).cast("int").alias("mb"), F.ceil(F.col("np") / block).cast("int").alias("pb"))
    salt = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    probes = filed.select("id", "label", "times", "dim", "v", "home", F.explode(F.concat(F.array("home"), "visits")).alias("cell")).join(loads, ["label", "dim", "cell"])
    probes = probes.select("label", "dim", "cell", "id", "times", "v", "home", F.lit(False).alias("member"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("i"), salt(F.col("pb")).alias("j"))
    filers = filed.withColumn("cell", F.col("home")).join(loads, ["label", "dim", "cell"])
    filers = filers.select("label", "dim", "cell", "id", "times", "v", "home", F.lit(True).alias("member"), salt(F.col("mb")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("pb") - 1)).alias("j"))
    met = durable(filers.unionByName(probes).groupBy("label", "dim", "cell", "i", "j").applyInPandas(_blocks(shared, cosine), "id long, n long, to long"))

    counts = met.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "rep")
    groups = components(met.select(F.col("id").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "rep")
    linked = members.join(counts, "rep", "left").join(groups, "rep", "left")
    linked = linked.select("id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = all_ids.join(linked, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
