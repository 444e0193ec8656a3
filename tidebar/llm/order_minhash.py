"""Near-duplicate documents by order MinHash and banded alignment.

Texts with equal words are one node at once. Of each node's shingles of five words, labelled with how often they occurred before,
every sketch takes the LEAST minimal ones under its own hash and keeps them in text order. Nodes with an equal sketch meet in a bucket.

Inside a bucket all members are held against each other on their sizes and on parity signatures, which no pair of the wanted similarity
fails; a bucket of more than BLOCK members is dealt out by bands of size and then as pairs of blocks. Of the pairs that pass, a
block gives a spanning forest alone, so a group of copies costs one row for each member. These pairs are verified on
the whole texts. Where a forest's pair fails, its block gives all its passing pairs between the classes that are still apart in a second pass:
then every pair that passes is verified or inside a class, and no link that shares a bucket is lost.

A pair is linked if the Jaccard similarity of its sets of shingles is at least SIMILARITY and a
banded alignment of its words finds at most (1 - SIMILARITY) of the longer text changed. At a similarity of 0.8, a
pair misses all 16 buckets with a probability of about one in 100,000.

Defined results: a text of fewer than five words is one shingle; texts without words are all copies of each other; a null doc_id
stays alone; repeated rows each get a row, and rows that share a doc_id but not the text are nodes of their own; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, small, word_bytes
from .components import components

K, SKETCHES, LEAST, SIMILARITY = 5, 16, 3, 0.8
#: Members of a block; bits of the smallest signature, and bits for each shingle at least; pairs of blocks and texts that one key holds.
BLOCK, BITS, DENSE, HELD = 1_024, 256, 4, 256
#: 64-bit words that are compared at once.
CELLS = 1 << 21
_MULTIPLIERS = np.array([int.from_bytes(hashlib.sha256(b"sketch %d" % i).digest()[:8], "little") | 1 for i in range(SKETCHES)], dtype=np.uint64)
_SEEN: dict[bytes, int] = {}


def word_ids(text: str | None) -> np.ndarray:
    if len(_SEEN) > 200_000:  # bounds a worker's memory, not the result
        _SEEN.clear()
    out = []
    for w in word_bytes(text):
        h = _SEEN.get(w)
        if h is None:
            h = _SEEN[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(ids: np.ndarray) -> np.ndarray:
    """Hashes of K consecutive words, in text order; of all words if there are fewer."""
    k = min(K, len(ids))
    if not k:
        return np.zeros(1, dtype=np.uint64)
    h = np.zeros(len(ids) - k + 1, dtype=np.uint64)
    for i in range(k):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - k + 1 + i])
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """Equal shingles told apart by how many stood before."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if new.all():
        return h
    at = np.arange(len(s))
    nth = np.empty(len(s), dtype=np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.where(nth > 0, _mix(h + nth * np.uint64(0x632BE59BD9B4E019)), h)


def sketches(h: np.ndarray) -> list[int]:
    """One signed 64-bit value for each sketch."""
    h = labelled(h)
    scaled = _mix(h)[None, :] * _MULTIPLIERS[:, None]
    if len(h) > LEAST:
        at = np.sort(np.argpartition(scaled, LEAST, axis=1)[:, :LEAST], axis=1)
    else:
        at = np.broadcast_to(np.arange(len(h)), (SKETCHES, len(h)))
    out = np.arange(SKETCHES, dtype=np.uint64)
    for i in range(at.shape[1]):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[at[:, i]])
    return out.view(np.int64).tolist()


def signature(h: np.ndarray) -> tuple[int, bytes]:
    """The number of different shingles, and for each of 2**n bins, DENSE a shingle or more, whether an odd number of them falls there."""
    own = np.unique(h)
    bins = BITS
    while bins < DENSE * len(own):
        bins *= 2
    odd = np.bincount((own & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return len(own), np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def close_pairs(sizes: np.ndarray, signs: np.ndarray, least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs, each once, that sizes and signatures do not rule out: as many bits as differ, so many shingles at least are in one set alone.

    Sizes in the ratio ``least`` have signatures of one length or of neighbouring ones; the longer is folded to the shorter.
    """
    lengths = np.array([len(s) for s in signs])
    table = {w: (np.flatnonzero(lengths == w), np.frombuffer(b"".join(signs[lengths == w]), np.uint64).reshape(-1, w // 8)) for w in np.unique(lengths).tolist()}
    xs, ys = [], []
    for w, (own, a) in table.items():
        for other, b in [(own, a)] + ([(table[2 * w][0], table[2 * w][1][:, : w // 8] ^ table[2 * w][1][:, w // 8 :])] if 2 * w in table else []):
            step = max(1, CELLS // (len(other) * a.shape[1]))
            for at in range(0, len(own), step):
                mine = own[at : at + step]
                n, m = sizes[mine][:, None], sizes[other][None, :]
                fits = np.minimum(n, m) >= least * np.maximum(n, m)
                if b is a:
                    fits &= mine[:, None] < other[None, :]
                if not fits.any():
                    continue
                bits = np.bitwise_count(a[at : at + step, None, :] ^ b[None, :, :]).sum(-1, dtype=np.int64)
                x, y = np.nonzero(fits & (bits <= (n + m) * ((1 - least) / (1 + least)) + 1e-6))
                xs.append(mine[x])
                ys.append(other[y])
    none = np.zeros(0, dtype=np.int64)
    x, y = np.concatenate([none, *xs]), np.concatenate([none, *ys])
    return np.minimum(x, y), np.maximum(x, y)


def forest(n: int, x: np.ndarray, y: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs that connect what the pairs (x < y) connect, those of the first members first."""
    if len(x) < 2:
        return x.tolist(), y.tolist()
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    root, left, right = np.arange(n), [], []
    hubs, starts = np.unique(x, return_index=True)
    for hub, near in zip(hubs.tolist(), np.split(y, starts[1:]), strict=True):
        roots, first = np.unique(root[near], return_index=True)
        fresh = roots != root[hub]
        if fresh.any():
            left += [hub] * int(fresh.sum())
            right += near[first[fresh]].tolist()
            root[np.isin(root, roots)] = root[hub]
    return left, right


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of shingles without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _out_of_place(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """How many entries of a have no equal in b within ``band`` places."""
    if not len(b):
        return len(a)
    order, values = np.argsort(b, kind="stable"), np.unique(b)
    rank = np.searchsorted(values, a)
    known = (rank < len(values)) & (values[np.minimum(rank, len(values) - 1)] == a)
    # places of equal values are in order, so (value, place) pairs are sorted as one number
    width = len(b) + 2 * band + 2
    places = np.searchsorted(values, b[order]) * width + order
    at = np.arange(len(a))[known]
    low = np.searchsorted(places, rank[known] * width + np.maximum(at - band, 0))
    high = np.searchsorted(places, rank[known] * width + at + band, side="right")
    return int((~known).sum() + (low == high).sum())


def within_band(a: np.ndarray, b: np.ndarray, band: int, plain: int = 24) -> bool:
    """Whether at most ``band`` insertions, deletions and substitutions turn a into b: furthest reach by diagonal.

    Up to ``plain`` edits diagonals are followed one by one; beyond, words and pairs of words that have no equal in the
    band are counted, as each edit touches at most one word and two pairs, and then all diagonals go on at once.
    """
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return False

    def slide(x: int, y: int) -> int:
        while x < n and y < m:
            size = min(128, n - x, m - y)
            bad = np.flatnonzero(a[x : x + size] != b[y : y + size])
            if len(bad):
                return x + int(bad[0])
            x, y = x + size, y + size
        return x

    reach = {0: slide(0, 0)}
    for d in range(min(band, plain) + 1):
        if reach.get(n - m, -1) >= n:
            return True
        new = {}
        for k in range(-d - 1, d + 2):
            if abs(k - (n - m)) > band - d - 1:
                continue  # too few edits are left to come back to the end's diagonal
            x = max(reach.get(k, -2) + 1, reach.get(k - 1, -2) + 1, reach.get(k + 1, -2))
            if x >= 0:
                x = min(x, n, m + k)
                new[k] = slide(x, x - k) if x - k >= 0 else x
        reach = new
    if band <= plain:
        return False
    pair = lambda w: _mix(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:])
    if _out_of_place(a, b, band) > band or _out_of_place(pair(a), pair(b), band) > 2 * band:
        return False
    return _all_diagonals(a, b, band, plain + 1, reach)


def _all_diagonals(a: np.ndarray, b: np.ndarray, band: int, d: int, reach: dict[int, int]) -> bool:
    """within_band from the d-th edit on, with arrays over the diagonals; equal stretches are skipped by hashes of doubling length."""
    n, m = len(a), len(b)
    levels = [(a, b)]
    while 2 << len(levels) <= min(n, m):
        half, (p, q) = 1 << (len(levels) - 1), levels[-1]
        levels.append(tuple(_mix(x[:-half] * np.uint64(0x9E3779B97F4A7C15) + x[half:]) for x in (p, q)))
    far, centre = np.full(2 * band + 3, -2, dtype=np.int64), band + 1
    for k, x in reach.items():
        far[k + centre] = x
    ks = np.arange(-centre, centre + 1)
    while d <= band:
        if far[n - m + centre] >= n:
            return True
        d += 1
        new = np.maximum(far + 1, np.maximum(np.concatenate([[-2], far[:-1]]) + 1, np.concatenate([far[1:], [-2]])))
        on = (new >= 0) & (np.abs(ks) <= d) & (np.abs(ks - (n - m)) <= band - d)
        x, k = np.minimum(np.minimum(new[on], n), m + ks[on]), ks[on]
        ahead = np.flatnonzero(x - k >= 0)
        for level in reversed(range(len(levels))):
            p, q = levels[level]
            while True:
                fits = ahead[(x[ahead] < len(p)) & (x[ahead] - k[ahead] < len(q))]
                fits = fits[p[x[fits]] == q[x[fits] - k[fits]]]
                x[fits] += 1 << level
                if not len(fits) or level < len(levels) - 1:
                    break
        far = np.full(2 * band + 3, -2, dtype=np.int64)
        far[k + centre] = x
    return False


def linked(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Of two texts' word ids."""
    return similarity(np.unique(shingles(a)), np.unique(shingles(b))) >= least and aligned(a, b, least)


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    return within_band(a, b, int((1 - least) * max(len(a), len(b)) + 1e-9))


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for t in pdf["text"]:
            ids = word_ids(t)
            h = shingles(ids)
            rows.append((hashlib.blake2b(ids.tobytes(), digest_size=16).digest(), sketches(h), *signature(h)))
        made = pd.DataFrame(rows, columns=["same", "sketch", "size", "sign"], index=pdf.index)
        yield pd.concat([pdf.drop(columns="text"), made], axis=1)


def _compared(all_apart: bool):
    """Blocks follow one another in a task, across its batches; of each its spanning forest, or all passing pairs of different classes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["bucket", "part", "across", "chunk", "id", "size", "sign", "c"]
        held = None
        for pdf in batches:
            own = [pdf[n].to_numpy() for n in names]
            held = [np.concatenate(x) for x in zip(held, own, strict=True)] if held else own
            new = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
            if len(new):
                yield _forests(held, [0, *new.tolist()], all_apart)
                held = [h[new[-1] :] for h in held]
        if held and len(held[0]):
            yield _forests(held, [0, len(held[0])], all_apart)

    return run


def _forests(columns: list[np.ndarray], bounds: list[int], all_apart: bool) -> pd.DataFrame:
    out = []
    for lo, hi in zip(bounds, bounds[1:]):
        bucket, part, across, chunk, ids, sizes, signs, classes = (c[lo:hi] for c in columns)
        x, y = close_pairs(sizes.astype(np.int64), signs)
        if across[0]:
            keep = chunk[x] != chunk[y]
            x, y = x[keep], y[keep]
        if all_apart:
            keep = classes[x] != classes[y]
            x, y = x[keep].tolist(), y[keep].tolist()
        else:
            x, y = forest(hi - lo, x, y)
        out += [(bucket[0], part[0], ids[i], ids[j]) for i, j in zip(x, y, strict=True)]
    return pd.DataFrame(out, columns=["bucket", "part", "a", "b"])


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a first text (b below 0) and then of those to hold against it."""
    words = own = None
    for pdf in batches:
        out = []
        for a, b, text in zip(pdf["a"], pdf["b"], pdf["text"], strict=True):
            ids = word_ids(text)
            if b < 0:
                words, own = ids, np.unique(shingles(ids))
            else:
                out.append((a, b, similarity(own, np.unique(shingles(ids))) >= SIMILARITY and aligned(words, ids)))
        yield pd.DataFrame(out, columns=["a", "b", "ok"])


def _verify(pairs: DataFrame, base: DataFrame, documents: DataFrame) -> DataFrame:
    """a, b, ok for pairs of nodes (a, b): only texts concerned move, a first one once for HELD others."""
    pairs = durable(pairs)
    named = durable(pairs.select(F.col("a").alias("rid")).union(pairs.select(F.col("b").alias("rid"))).distinct())
    rows = base.select("rid", F.col("doc_id").alias("own_id"), "text_hash").join(small(named), "rid")
    texts = documents.select("doc_id", F.md5("text").alias("hash"), "text")
    # a node without a word may stand for a null text, which has no hash; it is never one of a pair
    texts = texts.join(small(durable(rows)), (F.col("doc_id") == F.col("own_id")) & (F.col("hash") == F.col("text_hash"))).select("rid", "text").dropDuplicates(["rid"])
    texts = durable(texts)
    loads = pairs.groupBy("a").agg(F.ceil(F.count("*") / HELD).cast("int").alias("n"))
    first = loads.join(texts, F.col("a") == F.col("rid")).select("a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), F.lit(-1).cast("long").alias("b"), "text")
    other = pairs.join(loads, "a").join(texts, F.col("b") == F.col("rid")).select("a", F.pmod(F.xxhash64("b"), "n").cast("int").alias("part"), "b", "text")
    rows = first.unionByName(other).repartition("a", "part").sortWithinPartitions("a", "part", "b")
    return durable(rows.select("a", "b", "text").mapInPandas(_verified, "a long, b long, ok boolean"))


def _placed(nodes: DataFrame, met: DataFrame) -> DataFrame:
    """The nodes' rows by bucket and part; met has a row (rid, bucket, n) for each member of a bucket of n > 1."""
    own = met.groupBy("rid").agg(F.collect_list(F.struct("bucket", "n")).alias("buckets"))
    rows = nodes.select("rid", "size", "sign").join(small(durable(own), 50_000), "rid").select(F.col("rid").alias("id"), "size", "sign", F.inline("buckets"))
    # linked sizes differ by one band at most, so every linked pair of a large bucket shares one of its two bands
    band = F.floor(F.log("size") / float(-1.001 * np.log(SIMILARITY))).cast("int")
    rows = rows.withColumn("band", F.explode(F.when(F.col("n") > BLOCK, F.array(band, band + 1)).otherwise(F.array(F.lit(0)))))
    rows = durable(rows)
    loads = rows.where(F.col("n") > BLOCK).groupBy("bucket", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(small(durable(loads)), ["bucket", "band"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.concat_ws(":", "band", F.least("chunk", "other"), F.greatest("chunk", "other"))
    return rows.select("bucket", part.alias("part"), (F.col("chunk") != F.col("other")).alias("across"), "chunk", "id", "size", "sign")


def _in_blocks(rows: DataFrame, all_apart: bool) -> DataFrame:
    dealt = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "id")
    return dealt.mapInPandas(_compared(all_apart), "bucket long, part string, a long, b long")


def links(base: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Links (a, b) between nodes, of which the components follow; base has sketches and signatures by rid, nodes the rids that count."""
    own = durable(base.select("rid", "sketch").join(nodes, "rid", "left_semi"))
    every = own.select("rid", F.explode(F.array_distinct("sketch")).alias("bucket"))
    shared = durable(every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    placed = durable(_placed(base, durable(every.join(small(shared), "bucket"))))
    edges = durable(_in_blocks(placed.withColumn("c", F.col("id")), False))
    first = _verify(edges.select("a", "b").distinct(), base, documents)
    found = first.where("ok").select("a", "b")
    failed = first.where("not ok").select("a", "b")
    if failed.isEmpty():
        return found
    again = durable(edges.join(small(failed), ["a", "b"], "left_semi").select("bucket", "part").distinct())
    rows = placed.join(small(again), ["bucket", "part"], "left_semi").join(components(found), F.col("id") == F.col("node"), "left")
    rows = rows.withColumn("c", F.coalesce("component", "id")).drop("node", "component")
    rest = _in_blocks(rows, True).select("a", "b").distinct()
    second = _verify(rest.join(small(failed), ["a", "b"], "left_anti"), base, documents)
    return found.unionByName(second.where("ok").select("a", "b"))


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, class_id, kept for every row, written: kept is true for the class's least (doc_id, text_hash)."""
    docs = documents.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("string").alias("doc_id"), F.md5("text").alias("text_hash"), "text")
    made = docs.mapInPandas(_sketched, "rid long, doc_id string, text_hash string, same binary, sketch array<long>, size int, sign binary")
    base = durable(made.withColumn("doc_id", F.col("doc_id").cast("long")))
    known = base.where("doc_id is not null")
    nodes = durable(known.groupBy("same").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least")))
    groups = durable(components(links(base, nodes.select(F.col("node").alias("rid")), documents)))
    joined = durable(nodes.join(small(groups), "node").groupBy("component").agg(F.min("least").alias("class_id")))
    named = nodes.join(small(groups), "node", "left").withColumn("component", F.coalesce("component", "node")).join(small(joined), "component", "left")
    named = named.select("same", "component", F.coalesce("class_id", "least").alias("class_id"))
    sign = F.coalesce("text_hash", F.lit(""))
    rows = durable(known.select("doc_id", "text_hash", "same").join(named, "same").drop("same"))
    # texts of a class that share its least doc_id: the least hash stands for them
    ties = rows.where("doc_id = class_id").groupBy("component").agg(F.min(sign).alias("first"), F.max(sign).alias("last")).where("first <> last").drop("last")
    first = (F.col("doc_id") == F.col("class_id")) & (sign == F.coalesce("first", sign))
    rows = rows.join(small(durable(ties)), "component", "left").select("doc_id", "text_hash", "class_id", first.alias("kept"))
    alone = base.where("doc_id is null").select("doc_id", "text_hash", F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return durable(rows.unionByName(alone))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), kept (doc_id = class_id), for every row."""
    found = classes(documents)
    return found.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_first(documents: DataFrame) -> DataFrame:
    """documents with one row of each class: the least doc_id, then the least text hash; of wholly repeated rows one. Null doc_ids stay."""
    found = classes(documents)
    key = lambda d: [F.col("doc_id").alias("id_"), F.coalesce("text_hash", F.lit("")).alias("hash_")]
    gone = durable(found.where("not kept").select(*key(found)).distinct())
    twice = durable(found.where("kept and doc_id is not null").groupBy(*key(found)).count().where("count > 1").select("id_", "hash_"))
    same = (F.col("doc_id") == F.col("id_")) & (F.coalesce(F.md5("text"), F.lit("")) == F.col("hash_"))
    left = documents.join(small(gone), same, "left_anti")
    if twice.isEmpty():
        return left
    one = left.join(small(twice), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(small(twice), same, "left_anti").unionByName(one)
