"""Ranked lexical search: three-phase uniform thresholds (TPUT) over term-partitioned postings.

The texts are read once, into a forward table: for each document its words that stand in some query, with their numbers. From it come the lists: fragments
of a term's postings, one for each block of neighbouring documents, in falling order of impact, and dealt out by ranges of (term, impact), so that a common
term's list lies over many partitions.

1. The k best entries of every list give partial sums; a query's k-th best sum is a lower bound of its k-th score.
2. The bound divided by the number of the query's lists is one threshold for all of them. Entries at or above it go to their documents' block, where
   they are summed. What a document may still have in lists where it was not met is below the threshold (and nothing where the whole list was sent).
3. Documents whose sum and that rest reach the k-th best sum are candidates; their scores are looked up in the forward table.

No entry is dropped otherwise, so the ranking is exact. Queries run in blocks of at most ``TERMS`` (query, term) pairs (one query may have more), so that what
is sent to the workers with a task is bounded however many queries there are.

Defined results: null and empty texts have no terms, match nothing and are not counted in N; rows that share an item_id (null is one, too) are one query with all their
terms; repeated documents each take a rank, equal scores by doc_id (null first) and then by place in the table; a query without matches has no
rows; other columns are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, small, word_bytes, words_column

#: (query, term) pairs of one run.
TERMS = 100_000
#: A block has 2 ** BITS places for documents.
BITS = 11


def search(documents: DataFrame, queries: DataFrame, k: int = 50, terms: int = TERMS) -> DataFrame:
    """Per query its k best documents: item_id, rank, doc_id, score."""
    wanted = durable(queries.select("item_id", F.explode(words_column(F.col("text"))).alias("term")).distinct())
    blocks, most = 1, wanted.groupBy("item_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    block = lambda: F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    while wanted.groupBy(block()).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] > max(terms, most):
        blocks *= 2
    parts = [_search_block(documents, wanted.where(block() == b), k) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def _search_block(documents: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    spark, pairs = documents.sparkSession, wanted.collect()
    number = {t: i for i, t in enumerate(sorted({r["term"] for r in pairs}))}
    items = {i: no for no, i in enumerate(dict.fromkeys(r["item_id"] for r in pairs))}
    keyed = documents.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    schema = f"rid long, doc_id {documents.schema['doc_id'].dataType.simpleString()}, n int, terms array<int>, tfs array<int>"
    forward = durable(keyed.mapInArrow(_forward({t.encode("utf-8", "surrogatepass"): i for t, i in number.items()}), schema))
    n, total = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    lists = forward.mapInArrow(_fragments(n, total), "term int, block long, top int, low int, at array<int>, impact array<int>")
    order = [F.col("term"), F.col("top").desc(), F.col("block")]
    lists = durable(lists.repartitionByRange(*order).sortWithinPartitions(*order))
    # one row for each query term
    known = {r["term"]: r for r in lists.groupBy("term").agg(F.sum(F.size("at")).alias("df"), F.min("low").alias("low")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1))) for t, r in known.items()}
    asked: dict[int, list[tuple[int, int]]] = {}
    for r in pairs:
        t = number[r["term"]]
        if weight.get(t, 0) > 0:
            asked.setdefault(items[r["item_id"]], []).append((t, weight[t]))
    uses = spark.createDataFrame([(q, t, w) for q, ts in asked.items() for t, w in ts], "q int, term int, w long")

    # 1: heads of the lists
    head = lists.select("term", "block", F.inline(F.arrays_zip(F.slice("at", 1, k).alias("at"), F.slice("impact", 1, k).alias("impact"))))
    by = Window.partitionBy("term").orderBy(F.col("impact").desc(), "block", "at")
    head = head.withColumn("no", F.row_number().over(by)).where(F.col("no") <= k)
    sums = head.join(F.broadcast(uses), "term").groupBy("q", "block", "at").agg(F.sum(F.col("w") * F.col("impact")).alias("total"))
    first = _kth(sums, k)

    # 2: one threshold for all lists of a query
    plan, need = {}, {}
    for q, ts in asked.items():
        threshold = max(1, -(-first.get(q, 0) // len(ts)))
        plan[q] = [(t, w, -(-threshold // w), threshold - 1 if known[t]["low"] * w < threshold else 0) for t, w in ts]
        for t, _, least, _ in plan[q]:
            need[t] = min(need.get(t, least), least)
    needed = F.broadcast(spark.createDataFrame(list(need.items()), "term int, least int"))
    sent = lists.join(needed, "term").where(F.col("top") >= F.col("least"))
    keep = lambda c: F.when(F.col("low") >= F.col("least"), F.col(c)).otherwise(F.slice(c, 1, F.size(F.filter("impact", lambda x: x >= F.col("least")))))
    sent = sent.select("block", "term", keep("at").alias("at"), keep("impact").alias("impact"))
    met = durable(sent.groupBy("block").applyInPandas(_sums(plan, first, k), "q int, block long, at int, total long, most long"))
    second = spark.createDataFrame(list(_kth(met, k).items()), "q int, kth long")
    candidates = met.join(F.broadcast(second), "q", "left").where(F.col("most") >= F.coalesce("kth", F.lit(1)))

    # 3: exact scores of the candidates
    rid = F.shiftleft("block", BITS) + F.col("at")
    candidates = durable(candidates.groupBy(rid.alias("rid")).agg(F.collect_set("q").alias("qs")))
    exact = forward.join(small(candidates), "rid").mapInArrow(_exact(plan, n, total), f"rid long, {schema.split(', ')[1]}, q int, score long")
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "doc_id", "rid")
    exact = exact.where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(no, i) for i, no in items.items()], f"q int, item_id {wanted.schema['item_id'].dataType.simpleString()}")
    return exact.join(F.broadcast(names), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _kth(sums: DataFrame, k: int) -> dict[int, int]:
    """Per query its k-th greatest total; one row for each query of the run."""
    by = Window.partitionBy("q").orderBy(F.col("total").desc())
    found = sums.withColumn("no", F.row_number().over(by)).where(F.col("no") <= k).where(F.col("no") == k)
    return {r["q"]: r["total"] for r in found.select("q", "total").collect()}


def _forward(number: dict[bytes, int]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends, terms, tfs = [], [0], [], []
            for text in batch.column("text"):
                words = word_bytes(text.as_py())
                for w, tf in Counter(words).items():
                    if w in number:
                        terms.append(number[w])
                        tfs.append(tf)
                sizes.append(len(words))
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(sizes, pa.int32()), *lists], ["rid", "doc_id", "n", "terms", "tfs"])

    return read


def _impacts(batch: pa.RecordBatch, n: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all entries of a batch of forward rows: row in the batch, term, impact (below 1,000,000)."""
    terms, tfs = batch.column("terms"), batch.column("tfs").flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(batch)), np.diff(terms.offsets.to_numpy()))
    m = 50 + (50 * batch.column("n").to_numpy().astype(np.int64) * n) // max(total, 1)
    return row, terms.flatten().to_numpy(), (1_000_000_000 * tfs) // (1000 * tfs + 20 * m[row])


def _fragments(n: int, total: int):
    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, impact = _impacts(batch, n, total)
            if not len(row):
                continue
            rid = batch.column("rid").to_numpy()[row]
            block, at = rid >> BITS, (rid & ((1 << BITS) - 1)).astype(np.int32)
            order = np.lexsort((at, -impact, block, term))
            term, block, at, impact = term[order], block[order], at[order], impact[order].astype(np.int32)
            new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])])
            last = np.r_[new[1:], len(term)]
            ends = pa.array(np.r_[new, len(term)], pa.int32())
            columns = [term[new], block[new], impact[new], impact[last - 1]]
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at, impact)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *lists], ["term", "block", "top", "low", "at", "impact"])

    return invert


def _sums(plan: dict[int, list[tuple[int, int, int, int]]], first: dict[int, int], k: int):
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        entries: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for t, at, impact in zip(pdf["term"], pdf["at"], pdf["impact"], strict=True):
            entries.setdefault(t, []).append((at, impact.astype(np.int64)))
        out = []
        for q, uses in plan.items():
            total, met = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
            for t, w, least, rest in uses:
                for at, impact in entries.get(t, ()):
                    sent = at[: np.searchsorted(-impact, -least, side="right")]
                    total[sent] += w * impact[: len(sent)]
                    met[sent] += rest
            hit = np.flatnonzero(total)
            if not len(hit):
                continue
            total, most = total[hit], (total + sum(u[3] for u in uses) - met)[hit]
            own = np.partition(total, -k)[-k] if len(hit) >= k else 0
            near = most >= max(first.get(q, 0), own)
            out.append(pd.DataFrame({"q": q, "block": pdf["block"].iloc[0], "at": hit[near], "total": total[near], "most": most[near]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("q", "block", "at", "total", "most")}, dtype=np.int64)

    return add


def _exact(plan: dict[int, list[tuple[int, int, int, int]]], n: int, total: int):
    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, impact = _impacts(batch, n, total)
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(batch)))] if len(batch) else [0]
            at, qs, scores = [], [], []
            for i, asked in enumerate(batch.column("qs").to_pylist()):
                own = dict(zip(term[ends[i] : ends[i + 1]].tolist(), impact[ends[i] : ends[i + 1]].tolist(), strict=True))
                for q in asked:
                    at.append(i)
                    qs.append(q)
                    scores.append(sum(w * own.get(t, 0) for t, w, _, _ in plan[q]))
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("rid").take(taken), batch.column("doc_id").take(taken), pa.array(qs, pa.int32()), pa.array(scores, pa.int64())], ["rid", "doc_id", "q", "score"])

    return look_up
