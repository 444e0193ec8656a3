"""The nearest earlier origins of every bar, among those whose outcome was known by then.

An origin's fingerprint is three numbers: the log returns of 12 and of 24 bars, and the root mean square of the last 24. Origins stand on a fixed grid, so those known at a bar are the
first m of their series, and every m is a sum of powers of two: the origins fall into static runs of 1, 2, 4 ... blocks, and a bar looks into one run for each power in m, and into its last, partial block. A run is an index of
its own: its origins are dealt into cells along the three axes, and a bar's cells are visited outwards until the nearest ones are certain. No bar meets all origins, no task holds a whole series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bars between an origin and its outcome, the first origin, bars between origins, and neighbours.
AHEAD, FIRST, STEP, NEIGHBOURS = 10, 80, 8, 5
#: Origins of a block, and the greatest power of two of blocks in a run.
BLOCK, POWER = 64, 10


class Cells:
    """Points of three coordinates in a grid; the k nearest of a point, ties by number."""

    def __init__(self, numbers: np.ndarray, points: np.ndarray):
        self.numbers, self.points = numbers, points
        self.low = points.min(axis=0)
        # about four points in a cell if they were spread evenly
        self.side = max(1, int(round((len(points) / 4) ** (1 / 3))))
        spread = points.max(axis=0) - self.low
        self.width = np.where(spread > 0, spread / self.side, 1.0)
        own = self._cell(points)
        order = np.lexsort((numbers, *own.T[::-1]))
        self.at: dict[tuple, np.ndarray] = {}
        own = own[order]
        new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]).any(axis=1)])
        for a, b in zip(new, np.r_[new[1:], len(own)], strict=True):
            self.at[tuple(own[a].tolist())] = order[a:b]

    def _cell(self, points: np.ndarray) -> np.ndarray:
        # points outside lie in cells beyond the edge as far as a ring can see
        return np.clip(np.floor((points - self.low) / self.width), -1, self.side).astype(np.int64)

    def nearest(self, point: np.ndarray, k: int) -> list[tuple[float, int, int]]:
        """(distance, number, place)"""
        if len(self.points) <= BLOCK:
            return self._best(np.arange(len(self.points)), point, k)
        centre = self._cell(point[None])[0]
        found, ring = np.empty(0, np.int64), 0
        while True:
            shell = [self.at[c] for c in self._shell(centre, ring) if c in self.at]
            found = np.concatenate([found, *shell]) if shell else found
            best = self._best(found, point, k)
            # every point that is not in the rings so far lies beyond one of their faces
            inner = np.where(centre - ring <= 0, np.inf, point - (self.low + (centre - ring) * self.width))
            outer = np.where(centre + ring >= self.side, np.inf, self.low + (centre + ring + 1) * self.width - point)
            face = min(inner.min(), outer.min())
            if face == np.inf or (len(best) == k and best[-1][0] < face):
                return best
            ring += 1

    def _shell(self, c: np.ndarray, ring: int):
        lo, hi = np.maximum(c - ring, 0), np.minimum(c + ring, self.side)
        for x in range(lo[0], hi[0] + 1):
            for y in range(lo[1], hi[1] + 1):
                if max(abs(x - c[0]), abs(y - c[1])) == ring:
                    yield from ((x, y, z) for z in range(lo[2], hi[2] + 1))
                else:
                    yield from ((x, y, z) for z in {c[2] - ring, c[2] + ring} if lo[2] <= z <= hi[2])

    def _best(self, places: np.ndarray, point: np.ndarray, k: int) -> list[tuple[float, int, int]]:
        d = np.sqrt(((self.points[places] - point) ** 2).sum(axis=1))
        order = np.lexsort((self.numbers[places], d))[:k]
        return [(float(d[i]), int(self.numbers[places[i]]), int(places[i])) for i in order]


def fingerprints(bars: DataFrame) -> DataFrame:
    """symbol, t, i (from 0), c, r12, r24, vol, and the close and time AHEAD bars later. Returns that are not there count as 0."""
    s = Window.partitionBy("symbol").orderBy("t")
    ret = lambda n: F.when((F.col("c") > 0) & (F.lag("c", n).over(s) > 0), F.log(F.col("c") / F.lag("c", n).over(s)))
    df = bars.select("symbol", "t", "c", (F.row_number().over(s) - 1).alias("i"), ret(1).alias("x"), *[F.coalesce(ret(n), F.lit(0.0)).alias(f"r{n}") for n in (12, 24)], F.lead("c", AHEAD).over(s).alias("later"), F.lead("t", AHEAD).over(s).alias("later_t"))
    vol = F.sqrt(F.avg(F.col("x") * F.col("x")).over(s.rowsBetween(-23, 0)))
    return df.withColumn("vol", F.coalesce(vol, F.lit(0.0))).drop("x")


def analogs(bars: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """symbol, t, rank, origin_t, known_t, distance, realized: of every bar with history enough, its k nearest origins whose outcome is known with that bar's close."""
    df = fingerprints(bars)
    no = ((F.col("i") - FIRST) / STEP).cast("long")
    origins = df.where((F.col("i") >= FIRST) & ((F.col("i") - FIRST) % STEP == 0) & F.col("later").isNotNull())
    # an origin without a realised return keeps its number, but is found by no one
    realized = F.when((F.col("c") > 0) & (F.col("later") > 0), F.log(F.col("later") / F.col("c")))
    # under names of their own, as both sides of the join come from one table
    origins = origins.select(F.col("symbol").alias("series"), no.alias("no"), F.col("r12").alias("x"), F.col("r24").alias("y"), F.col("vol").alias("z"), F.col("t").alias("origin_t"), F.col("later_t").alias("known_t"), realized.alias("realized")).where("realized is not null")
    known = F.floor((F.col("i") - AHEAD - FIRST) / STEP).cast("long") + 1
    queries = df.where(F.col("i") >= FIRST + AHEAD).select("symbol", "t", "r12", "r24", "vol", known.alias("m"))

    whole = F.floor(F.col("m") / BLOCK).cast("long")
    # the whole blocks: as many greatest runs as fit, then one run for each power of two; and the block that is not full yet
    bulk = F.shiftright(whole, POWER)
    top = F.when(bulk > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(bulk - 1, F.lit(0))), lambda j: F.struct(F.lit(POWER).alias("power"), j.alias("run"))))
    rest = F.filter(F.transform(F.sequence(F.lit(0), F.lit(POWER - 1)), lambda p: F.struct(p.alias("power"), F.floor(whole / F.pow(F.lit(2.0), p)).cast("long").alias("run"))), lambda s: s["run"] % 2 == 1)
    # the run of power p that ends where the higher ones begin: its number is (whole >> p) - 1
    rest = F.transform(rest, lambda s: F.struct(s["power"].alias("power"), (s["run"] - 1).alias("run")))
    partial = F.array(F.struct(F.lit(-1).alias("power"), whole.alias("run")))
    none = F.array().cast("array<struct<power:int,run:bigint>>")
    queries = queries.withColumn("part", F.explode(F.concat(F.coalesce(top, none), rest, partial))).select("symbol", "t", "r12", "r24", "vol", "m", "part.power", "part.run")
    block = F.floor(F.col("no") / BLOCK).cast("long")
    places = F.concat(F.array(F.struct(F.lit(-1).alias("power"), block.alias("run"))), F.transform(F.sequence(F.lit(0), F.lit(POWER)), lambda p: F.struct(p.alias("power"), F.floor(block / F.pow(F.lit(2.0), p)).cast("long").alias("run"))))
    origins = origins.withColumn("part", F.explode(places)).select("series", "part.power", "part.run", "no", "x", "y", "z", "origin_t", "known_t", "realized")

    def look(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        columns = ["symbol", "t", "no", "origin_t", "known_t", "distance", "realized"]
        if not len(there) or not len(asked):
            return pd.DataFrame([], columns=columns)
        there = there.sort_values("no", ignore_index=True)
        points, numbers = np.column_stack([there[c].to_numpy() for c in "xyz"]), there["no"].to_numpy()
        partial_ = asked["power"].iloc[0] < 0
        cells, rows = None if partial_ else Cells(numbers, points), []
        for q in asked.itertuples(index=False):
            point = np.array([q.r12, q.r24, q.vol])
            if partial_:
                first = int(np.searchsorted(numbers, q.m))
                best = Cells(numbers[:first], points[:first]).nearest(point, k) if first else []
            else:
                best = cells.nearest(point, k)
            rows += [(q.symbol, q.t, n, there["origin_t"].iloc[at], there["known_t"].iloc[at], d, there["realized"].iloc[at]) for d, n, at in best]
        return pd.DataFrame(rows, columns=columns, dtype=object)

    keys = ["symbol", "power", "run"]
    found = queries.groupBy(*keys).cogroup(origins.groupBy("series", "power", "run")).applyInPandas(look, "symbol string, t long, no long, origin_t long, known_t long, distance double, realized double")
    best = Window.partitionBy("symbol", "t").orderBy("distance", "no")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("symbol", "t", "rank", "origin_t", "known_t", "distance", "realized")
