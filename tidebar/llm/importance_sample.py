"""Draws documents that look like a target set: hashed n-gram weights, a Gumbel key, and an exact external top draw.

Weights are read from an array of ``buckets`` gains, fitted on all rows of both sides. Every partition's eligible rows are sorted into a run, written in chunks of
``CHUNK`` rows that no range of scores divides. A range's chunks, of all runs, are merged by a tournament tree that reads them in the order of their first rows and
opens a chunk only when its first row is due, so it holds one chunk of a run at most. Ranges' counts say where each one's ranks begin and which range holds the
last draw; its merge stops there, and no range beyond is merged at all.

Defined results: null texts have no words; a null doc_id counts as an empty one in the key and comes first among equal scores; repeated rows are drawn each for itself, in the order of
their place in the table; other columns are ignored; with an empty target gains follow from T = 0; an empty table gives an empty result.
Rows of one score are in one range: they pass one task, as a stream.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import durable, word_bytes

#: Rows of a chunk of a run, and about how many drawn rows a range has at most.
CHUNK, RANGE = 256, 200_000
#: At most so many ranges.
RANGES = 4096


def features(text: str | None, ngrams: int, buckets: int) -> tuple[int, int, dict[int, int]]:
    """Words, features, and features by bucket, of one text."""
    words = word_bytes(text)
    found: Counter[int] = Counter()
    for n in range(1, ngrams + 1):
        runs = words if n == 1 else [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        for run, times in Counter(runs).items():
            found[zlib.crc32(run) % buckets] += times
    return len(words), sum(found.values()), found


def _counted(ngrams: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes, ends, at, times = [], [], [0], [], []
            for text in batch.column("text"):
                n_words, size, found = features(text.as_py(), ngrams, buckets)
                words.append(n_words)
                sizes.append(size)
                at.extend(found.keys())
                times.extend(found.values())
                ends.append(len(at))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (at, times)]
            own = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), *lists], [*own, "n_words", "n_features", "at", "times"])

    return count


_COUNTS = "n_words long, n_features long, at array<int>, times array<int>"


def _bucket_totals(counted: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket over all rows; every task sends one row for each bucket it met."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch.column("at").flatten().to_numpy(), batch.column("times").flatten().to_numpy())
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in counted.select("at", "times").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, from the features by bucket of both sides."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: str | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gain: np.ndarray, seed: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column("at").offsets.to_numpy()
            sums = np.r_[0, np.cumsum(gain[batch.column("at").flatten().to_numpy()] * batch.column("times").flatten().to_numpy())]
            weight = sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]]
            noise = np.array([gumbel(d, seed) for d in batch.column("doc_text").to_pylist()], np.int64)
            own = [batch.column(c) for c in ("rid", "doc_id", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(weight), pa.array(weight + noise)], ["rid", "doc_id", "n_words", "n_features", "weight", "score"])

    return score


class Tournament:
    """A tree of matches over slots; the least key wins. An empty slot holds None and loses to all."""

    def __init__(self):
        self.size, self.keys, self.won = 1, [None], [0, 0]

    def _match(self, node: int) -> int:
        a, b = (node * 2 - self.size, node * 2 + 1 - self.size) if node * 2 >= self.size else (self.won[node * 2], self.won[node * 2 + 1])
        ka, kb = self.keys[a], self.keys[b]
        return b if ka is None or (kb is not None and kb < ka) else a

    def put(self, slot: int, key) -> None:
        if slot >= self.size:
            self.keys += [None] * self.size
            self.size *= 2
            self.won = [0] * self.size
            self.keys[slot] = key
            for node in range(self.size - 1, 0, -1):
                self.won[node] = self._match(node)
            return
        self.keys[slot] = key
        node = (slot + self.size) // 2
        while node:
            self.won[node] = self._match(node)
            node //= 2

    def winner(self) -> tuple[int, tuple | None]:
        slot = self.won[1] if self.size > 1 else 0
        return slot, self.keys[slot]


def merge(chunks: Iterator[list[tuple]], stop: int) -> Iterator[tuple[tuple, bool]]:
    """Rows of sorted chunks: the first ``stop`` in order, with True, then the others as they come, with False.

    The chunks come in the order of their first rows; one is opened when its first row is due.
    """
    tree, opened, free = Tournament(), {}, []
    coming = next(chunks, None)
    for _ in range(stop):
        slot, row = tree.winner()
        while coming is not None and (row is None or coming[0] < row):
            at = free.pop() if free else len(opened)
            opened[at] = iter(coming)
            tree.put(at, next(opened[at]))
            coming = next(chunks, None)
            slot, row = tree.winner()
        if row is None:
            return
        yield row, True
        after = next(opened[slot], None)
        tree.put(slot, after)
        if after is None:
            free.append(slot)
    yield from ((row, False) for row in tree.keys if row is not None)
    for left in opened.values():
        yield from ((row, False) for row in left)
    while coming is not None:
        yield from ((row, False) for row in coming)
        coming = next(chunks, None)


#: A chunk of a run; its first row is (top, id, first).
_RUN = "range int, top long, id {id}, first long, scores array<long>, ids array<{id}>, rids array<long>, sizes array<long>, weights array<long>"
_ARRAYS = {"scores": "score", "ids": "doc_id", "rids": "rid", "sizes": "n_features", "weights": "weight"}


def _cut(bounds: np.ndarray):
    """Chunks of sorted rows; range 0 has the highest scores."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            place = len(bounds) - np.searchsorted(bounds, batch.column("score").to_numpy(), side="right")
            new = np.r_[True, place[1:] != place[:-1]]
            begun = np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
            starts = np.flatnonzero((np.arange(len(place)) - begun) % CHUNK == 0)
            ends = pa.array(np.r_[starts, len(place)], pa.int32())
            first = pa.array(starts)
            columns = [pa.array(place[starts].astype(np.int32)), *(batch.column(c).take(first) for c in ("score", "doc_id", "rid"))]
            lists = [pa.ListArray.from_arrays(ends, batch.column(c)) for c in _ARRAYS.values()]
            yield pa.RecordBatch.from_arrays([*columns, *lists], ["range", "top", "id", "first", *_ARRAYS])

    return cut


def _merged(begins: dict[int, int], draws: int, kind: pa.DataType):
    """Rows with ranks, from chunks sorted by range and first row."""
    types = [kind, *[pa.int64()] * 4]

    def ranked(rows: Iterator[dict]) -> Iterator[tuple]:
        coming = next(rows, None)

        def chunks(place: int) -> Iterator[list[tuple]]:
            nonlocal coming
            while coming is not None and coming["range"] == place:
                now, coming = coming, next(rows, None)
                yield [(-s, d is not None, 0 if d is None else d, rid, n, w) for s, d, rid, n, w in zip(*(now[a] for a in _ARRAYS), strict=True)]

        while coming is not None:
            before = begins[coming["range"]]
            for no, (row, in_order) in enumerate(merge(chunks(coming["range"]), draws - before), before + 1):
                yield row[2] if row[1] else None, row[4], row[5], -row[0], no if in_order else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ranked(r for batch in batches for r in batch.to_pylist())
        while out := list(islice(rows, 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "n_features", "weight", "score", "rank"])

    return run


def draw(documents: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, ngrams: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """Every row of documents: doc_id, n_features, weight, score, rank (null where it is not drawn)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    keyed = documents.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("doc_id").cast("string").alias("doc_text"), "text")
    counted = durable(keyed.mapInArrow(_counted(ngrams, buckets), f"rid long, doc_id {kind}, doc_text string, {_COUNTS}"))
    gain = gains(_bucket_totals(counted, buckets), _bucket_totals(target.select("text").mapInArrow(_counted(ngrams, buckets), _COUNTS), buckets))
    scored = durable(counted.mapInArrow(_scored(gain, seed), f"rid long, doc_id {kind}, n_words long, n_features long, weight long, score long"))

    eligible = scored.where(F.col("n_words") >= least_words)
    draws = percent * eligible.count() // 100
    ranges = int(min(RANGES, max(int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")), draws // RANGE + 1)))
    # bounds of ranges that have about as many rows each among those that are drawn, and one range for the rest
    shares = [1 - percent / 100 * (i + 1) / ranges for i in range(ranges)]
    bounds = np.unique(eligible.approxQuantile("score", shares, percent / 100 / ranges / 4)) if draws else np.array([])
    runs = eligible.sortWithinPartitions(F.col("score").desc(), "doc_id", "rid")
    runs = durable(runs.mapInArrow(_cut(bounds), _RUN.format(id=kind)))
    begins, at = {}, 0
    for r in runs.groupBy("range").agg(F.sum(F.size("rids")).alias("n")).orderBy("range").collect():
        begins[r["range"]], at = at, at + r["n"]
    last = max((r for r, begin in begins.items() if begin < draws), default=-1)

    columns = ["doc_id", "n_features", "weight", "score"]
    due = runs.where(F.col("range") <= last).repartition("range").sortWithinPartitions("range", F.col("top").desc(), "id", "first")
    drawn = due.mapInArrow(_merged(begins, draws, to_arrow_type(documents.schema["doc_id"].dataType)), f"doc_id {kind}, n_features long, weight long, score long, rank long")
    beyond = runs.where(F.col("range") > last).select(F.inline(F.arrays_zip(*(F.col(a).alias(c) for a, c in _ARRAYS.items()))))
    rest = beyond.select(*columns).unionByName(scored.where(F.col("n_words") < least_words).select(*columns))
    return drawn.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))
