"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words and of their beginnings is fitted in numpy: confirmed toxic texts are the positives, and the unlabelled
texts are drawn from all documents, whatever their labels or with none. The risk of the negative class is corrected by the class prior and kept from
going below zero. The prior is counted over all learning rows of the labels, apart from the fit's own sample: the share of toxic
rows among those with a toxicity label. Labels that name toxic rows alone say nothing of the share; it is then toxic rows over documents.

Three classifiers are fitted, each on two thirds of the rows, and averaged; the threshold is where their scores of the rows that each left out err least.
The fit uses at most ``positives`` and ``unlabelled`` rows (documented bounds; by hash order), the prior and every
threshold follow from all labels; every row is scored on its whole text. Rows whose crc32(doc_id) mod 5 is 0 are never learnt from.
Defined results: null and empty texts get the score of a text without known words; without any positive
row all scores are 0; rows that share a doc_id are scored each by its text, and of such rows one is learnt from; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import word_bytes

POSITIVES, UNLABELLED, VOCABULARY = 3_000, 9_000, 30_000


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the rows that may be learnt from; of repeated rows a confirmed one counts."""
    return labels.where(~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))


def class_prior(documents: DataFrame, labels: DataFrame) -> float:
    """The share of toxic texts, over all learning rows."""
    toxic, clean = known_labels(labels).agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count_if(F.col("toxic") == 0)).first()
    total = toxic + clean if clean else documents.where(~held_out()).count()
    return toxic / max(total, 1)


def learning_rows(documents: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> list:
    """A bounded sample by hash order: confirmed rows, and rows of all documents. A row can be in both."""
    first = lambda ids, n: ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    toxic = first(known_labels(labels).where("toxic = 1").select("doc_id", F.lit(1).alias("toxic")), positives)
    drawn = first(documents.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id").distinct(), unlabelled).withColumn("toxic", F.lit(0))
    chosen = toxic.union(drawn).repartition("doc_id")
    # hashes of word sets, and no texts, go to the driver
    rows = documents.where(~held_out()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    return rows.mapInPandas(_word_sets, "toxic int, words binary").collect()


#: Bytes of a word's beginning that count as features of their own, beside the whole word.
BEGINNINGS = (4, 6)


def marks(text: str | None) -> set[bytes]:
    """The features of a text: its words, and the beginnings of the longer ones."""
    own = set(word_bytes(text))
    return own.union(*({w[:k] + b"~" for w in own if len(w) > k} for k in BEGINNINGS))


def _hash(mark: bytes) -> int:
    """32 bits: few features share one, and the sample that goes to the driver is half as large."""
    return xxhash.xxh32_intdigest(mark)


def _word_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets = [np.array(sorted({_hash(w) for w in marks(t)}), dtype=np.uint32).tobytes() for t in pdf["text"]]
        yield pd.DataFrame({"toxic": pdf["toxic"], "words": sets})


def fit(rows: list[tuple[int, bytes]], prior: float, **options) -> tuple[dict[int, float], float]:
    """Weights by feature hash, and the bias; the bias is set where scores of rows that were not fitted on err least,
    with the unlabelled rows' error corrected by the prior."""
    y = np.array([t for t, _ in rows], dtype=bool)
    if not y.any() or y.all():
        return {}, -30.0 if not y.any() else 0.0
    prior = float(np.clip(prior, 1e-6, 1 - 1e-6))
    raw = np.frombuffer(b"".join(w for _, w in rows), np.uint32)
    names, counts = np.unique(raw, return_counts=True)
    names = names[counts >= least_count(2 * len(y) // 3)]
    column, row = np.searchsorted(names, raw).astype(np.int32), np.repeat(np.arange(len(y), dtype=np.int32), [len(w) // 4 for _, w in rows])
    # what stands past its place is not among the names
    known = np.concatenate([names, [0]])[column] == raw
    known &= column < len(names)
    column, row = column[known], row[known]
    del raw, known
    # by the words, so that a text that is both confirmed and drawn is in one fold
    folds = np.array([zlib.crc32(w) % 3 for _, w in rows])
    if y.sum() < 10 or any(not y[folds != k].any() or y[folds != k].all() for k in range(3)):
        weights, bias = fit_once(y, row, column, len(names), prior, **options)
    else:
        weights, bias, left_out = np.zeros(len(names)), 0.0, np.zeros(len(y))
        for fold in range(3):
            own = folds == fold
            out, number = own[row], np.cumsum(~own) - 1
            part, b = fit_once(y[~own], number[row[~out]], column[~out], len(names), prior, **options)
            left_out += np.where(own, b, 0.0) + np.bincount(row[out], part[column[out]], len(y))
            weights, bias = weights + part / 3, bias + b / 3
        order = np.argsort(left_out, kind="stable")
        missed = np.cumsum(y[order]) / y.sum()
        flagged = 1 - np.cumsum(~y[order]) / (~y).sum()
        risk = prior * missed + np.maximum(0, flagged - prior * (1 - missed))
        best = int(np.argmin(risk))
        bias -= float((left_out[order[best]] + left_out[order[min(best + 1, len(y) - 1)]]) / 2)
    return {int(names[k]): float(weights[k]) for k in np.flatnonzero(np.abs(weights) > 1e-4)}, float(bias)


def least_count(n: int) -> int:
    """In how many of n rows a feature has to stand to have a weight."""
    return max(3, n // 500)


def corrected(z: np.ndarray, y: np.ndarray, prior: float) -> float:
    """The negatives' risk: the unlabelled rows' less the positives' share of it. It is below zero where the fit goes too far."""
    loss = np.logaddexp(0, z)
    return float(loss[~y].mean() - prior * loss[y].mean())


def gradient(z: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Of the non-negative risk, prior * (positives' risk) + max(0, corrected), by the rows' scores."""
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    g = np.where(y, prior * (p - 1) / y.sum(), 0.0)
    if corrected(z, y, prior) > 0:
        g += np.where(y, -prior * p / y.sum(), p / (~y).sum())
    return g


def fit_once(y, row, column, size: int, prior: float, steps: int = 200, rate: float = 0.05, l2: float = 2e-2) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk with the logistic loss. Of ``size`` features, the frequent enough have weights."""
    counts = np.bincount(column, minlength=size)
    chosen = np.flatnonzero(counts >= least_count(len(y)))
    chosen = chosen[np.argsort(-counts[chosen], kind="stable")][:VOCABULARY]
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    known = place[column] >= 0
    r, c = row[known].astype(np.int64), place[column][known]
    # a feature's pull is scaled by how rare it is, so that common ones add little noise
    scale = np.log(len(y) / np.maximum(counts[chosen], 1)) / np.log(max(len(y), 2))
    w, b = np.zeros(len(chosen)), np.log(prior / (1 - prior))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        g = gradient(b + np.bincount(r, (w * scale)[c], len(y)), y, prior)
        gw = np.bincount(c, g[r], len(chosen)) * scale + l2 * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= rate * fix * m / (np.sqrt(v) + 1e-8)
        b -= rate * fix * mb / (np.sqrt(vb) + 1e-8)
    weights = np.zeros(size)
    weights[chosen] = w * scale
    return weights, float(b)


def _scorer(shared):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, bias = shared.value
        known: dict[bytes, float] = {}
        for pdf in batches:
            z = np.empty(len(pdf))
            for k, text in enumerate(pdf["text"]):
                own = marks(text)
                if len(known) > 200_000:  # bounds a worker's memory, not the result
                    known.clear()
                known |= {w: weights.get(_hash(w), 0.0) for w in own if w not in known}
                # an exact sum, so that equal texts get equal scores
                z[k] = bias + math.fsum(known[w] for w in own)
            yield pdf.drop(columns="text").assign(score=1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score


def model(documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED):
    rows = learning_rows(documents, labels, positives, unlabelled)
    return documents.sparkSession.sparkContext.broadcast(fit(sorted((r.toxic, r.words) for r in rows), class_prior(documents, labels)))


def toxicity(documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    fitted = model(documents, labels, positives, unlabelled)
    scored = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(_scorer(fitted), "doc_id string, score double")
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that the classifier does not reject, with their own columns."""
    fitted = model(documents, labels)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # only the text goes to Python, so that extra columns of any name and large ids come back as they were
        for got in _scorer(fitted)(pd.DataFrame({"text": texts}) for texts in batches):
            yield got["score"]

    return documents.where(scored("text") < 0.5)
