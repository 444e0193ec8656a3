"""Substring dedup by hashing normalised units.

Lines are cut further into sentences: after closing punctuation, and before a word that begins with a capital. Long sentences are cut
before words whose hash is the least among their neighbours', so that a passage inside of other words falls into the same pieces wherever it stands. A unit's letters are
lower-cased and its spaces folded. Digests are grouped globally, counted in parts before the shuffle; the occurrence of the
least (doc_id, start) is kept. Neighbouring repeated units of a document form one passage; passages
of at least ``least`` words are removed, with their offsets in the original text. Of shorter ones whole lines are removed whose line stands before, each for itself.

Defined results: null and empty texts have no units; repeated rows (the same doc_id) count as one document's rows in
order of their text; ties go to the least doc_id and start; a row with a null doc_id comes after all others; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_long, as_text, durable, unused

UNIT = re.compile(r"\n+|(?<=[.!?])[^\S\n]+|[^\S\n]+(?=[A-ZÀ-ÖØ-Þ])")
WORD = re.compile(r"\S+")
LEAST = 10
#: Sentences of so many words are cut, at words with the least hash of so many on each side.
LONG, SIDE = 12, 3
#: Digests with more than one in so many of all units; there are fewer of them than this, so they are broadcast.
HOT_SHARE = 20_000


def _digest(ws: list[str], kind: bytes = b"") -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(ws).encode("utf-8", "surrogatepass"), digest_size=8, person=kind).digest(), "little", signed=True)


def _pieces(text: str, at: int, end: int, ws: list[str]) -> Iterator[tuple[int, int, list[str]]]:
    if len(ws) >= LONG:
        h = [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in ws]
        cuts = [i for i in range(SIDE, len(h) - SIDE) if h[i] < h[i - 1] and h[i] < h[i + 1] and h[i] < min(h[i - SIDE : i]) and h[i] < min(h[i + 1 : i + 1 + SIDE])]
        spans = [m.span() for m in WORD.finditer(text, at, end)] if cuts else []
        if len(spans) == len(ws):
            first = 0
            for i in cuts:
                yield at, spans[i - 1][1], ws[first:i]
                at, first = spans[i][0], i
            ws = ws[first:]
    yield at, end, ws


def units(text: str | None, least: int = LEAST) -> list[tuple[int, int, int, int, int, bool]]:
    """(number, start, end, words, 64-bit digest, False) of each unit with words, and (number of the first unit, start, end, words, digest, True)
    of each line of fewer than ``least`` words."""
    out, at, text = [], 0, text or ""
    no, line, begun = 0, [], None
    for end, after in [*((m.start(), m.end()) for m in UNIT.finditer(text)), (len(text), len(text))]:
        ws = text[at:end].lower().split()
        if ws:
            if begun is None:
                begun = (no, at)
            if len(line) < least:
                line += ws
            for start, stop, own in _pieces(text, at, end, ws):
                out.append((no, start, stop, len(own), _digest(own), False))
                no += 1
        if begun and (end == len(text) or text[end] == "\n"):
            if len(line) < least:
                out.append((begun[0], begun[1], out[-1][2], len(line), _digest(line, b"line"), True))
            line, begun = [], None
        at = after
    return out


def _units(least: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                rows = [(rid, d, *u) for rid, d, t in zip(part["rid"], part["doc_id"], part["text"], strict=True) for u in units(t, least)]
                yield pd.DataFrame(rows, columns=["rid", "doc_id", "no", "start", "end", "words", "digest", "line"])

    return cut


def repeated_passages(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per removed passage: rid, doc_id, start, end, n_words, n_units, kept_doc_ids (documents that keep it)."""
    return _passages(documents.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), least)


def _passages(docs: DataFrame, least: int) -> DataFrame:
    every = durable(as_long(docs.select("rid", as_text("doc_id"), "text").mapInPandas(_units(least), "rid long, doc_id string, no int, start int, end int, words int, digest long, line boolean"), "doc_id"))
    # a row without a doc_id keeps a unit only where no other row has it
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "rid", "start")
    firsts = durable(every.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    heavy = F.col("n") * HOT_SHARE > every.count()
    hot, rest = F.broadcast(firsts.where(heavy).drop("n")), firsts.where(~heavy).drop("n")
    # units of the commonest digests stay where they are; only the others are dealt out by digest
    again = every.join(hot, "digest").unionByName(every.join(hot, "digest", "left_anti").join(rest, "digest")).where(place > F.col("first"))
    # units count, lines do not: a line's row comes after that of its first unit and falls into the same run. All units of a repeated line are repeated
    by = Window.partitionBy("rid").orderBy("no", "line").rowsBetween(Window.unboundedPreceding, 0)
    again = again.withColumn("run", F.col("no") - F.sum((~F.col("line")).cast("int")).over(by))
    unit = lambda c: F.when(~F.col("line"), c)
    passage = lambda *cs: F.struct(*[c.alias(n) for c, n in zip(cs, ("start", "end", "n_words", "n_units", "kept_doc_ids"), strict=True)])
    line = passage(F.col("start"), F.col("end"), F.col("words").cast("long"), F.lit(1).cast("long"), F.array("first.doc_id"))
    runs = again.groupBy("rid", "doc_id", "run").agg(
        passage(F.min("start"), F.max("end"), F.sum(unit(F.col("words"))), F.count(unit(F.lit(1))), F.array_sort(F.collect_set(unit(F.col("first.doc_id"))))).alias("whole"),
        F.collect_list(F.when(F.col("line"), line)).alias("lines"),
    )
    return runs.select("rid", "doc_id", F.inline(F.when(F.col("whole.n_words") >= least, F.array("whole")).otherwise(F.col("lines"))))


def remove_repeats(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """documents without the repeated passages; removed (removed_ where there is such a column) lists their original offsets."""
    rid, removed = unused(documents, "rid", "removed")
    keyed = durable(documents.withColumn(rid, F.monotonically_increasing_id()))
    found = _passages(keyed.select(F.col(rid).alias("rid"), "doc_id", "text"), least)
    cuts = found.groupBy(F.col("rid").alias(rid)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(removed))
    rest = F.pandas_udf(_without, "string")("text", removed)
    return keyed.join(cuts, rid, "left").withColumn("text", rest).drop(rid)


def _without(texts: pd.Series, cuts: pd.Series) -> pd.Series:
    out = []
    for text, spans in zip(texts, cuts, strict=True):
        if spans is None or text is None:
            out.append(text)
            continue
        parts, at = [], 0
        for s in spans:
            parts.append(text[at : s["start"]])
            at = s["end"]
        out.append("".join([*parts, text[at:]]))
    return pd.Series(out, dtype=object)
