"""Edit-aware token counts.

Each document keeps the leaves of a tree over runs of pre-tokens: their lengths, token counts and, above
them, the sums of subtrees (an array in heap order). An edit re-encodes only the leaves
that it touches and their neighbours, whose borders are boundaries of pre-tokens in either version, and
updates the sums on the way up; no other text is encoded again.

A leaf ends where white space follows another character: there every split of the text
into pre-tokens has a boundary, whatever stands further on.
Defined results: null texts are empty; an edit's null place or cut is 0, its null text empty; an empty table gives an empty result; edits beyond the text are clipped to it; edits of one document are applied by
their number; repeated rows each get a row and all edits of their doc_id; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoding
from .common import as_long, as_text

LEAF = 1_000
_BORDER = re.compile(r"\S(?=\s)")


def leaves(text: str, size: int = LEAF) -> list[str]:
    out, at = [], 0
    while len(text) - at > size:
        m = _BORDER.search(text, at + size - 1)
        if not m:
            break
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]]


class Tree:
    """Leaves of one document and the sums of their token counts."""

    def __init__(self, text: str, count, size: int = LEAF):
        self.count, self.size, self.encoded = count, size, 0
        self.leaves = leaves(text, size)
        self._sums([self._counted(x) for x in self.leaves])

    def _counted(self, text: str) -> int:
        self.encoded += len(text)
        return self.count(text)

    def _sums(self, counts: list[int]) -> None:
        self.width = 1
        while self.width < len(counts):
            self.width *= 2
        self.sums = [0] * self.width + counts + [0] * (self.width - len(counts))
        for k in range(self.width - 1, 0, -1):
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    @property
    def total(self) -> int:
        return self.sums[1]

    def edit(self, at: int, cut: int, put: str) -> None:
        """Replace ``cut`` characters from ``at`` on by ``put``."""
        total = sum(map(len, self.leaves))
        at = max(0, min(at, total))
        end = max(at, min(at + max(0, cut), total))
        first, begin = 0, 0
        while first < len(self.leaves) - 1 and begin + len(self.leaves[first]) <= at:
            begin += len(self.leaves[first])
            first += 1
        last, stop = first, begin + len(self.leaves[first])
        while last < len(self.leaves) - 1 and stop < end:
            last += 1
            stop += len(self.leaves[last])
        # one leaf more on either side: the edit may undo the border between them
        lo, hi = max(0, first - 1), min(len(self.leaves) - 1, last + 1)
        begin -= len(self.leaves[lo]) if lo < first else 0
        joined = "".join(self.leaves[lo : hi + 1])
        new = leaves(joined[: at - begin] + put + joined[end - begin :], self.size)
        counts = [self._counted(x) for x in new]
        if len(new) == hi + 1 - lo:
            self.leaves[lo : hi + 1] = new
            for k, n in enumerate(counts, self.width + lo):
                step = n - self.sums[k]
                while k:
                    self.sums[k] += step
                    k //= 2
        else:
            old = self.sums[self.width : self.width + len(self.leaves)]
            self.leaves[lo : hi + 1] = new
            self._sums(old[:lo] + counts + old[hi + 1 :])


def _whole(x: float | None) -> int:
    """A null beside numbers arrives as NaN and makes them floats."""
    return 0 if x is None or x != x else int(x)


def _recount(path: str | None, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                tree = Tree(r.text or "", lambda t: len(encode(t)), size)
                before, n_leaves, first = tree.total, len(tree.leaves), tree.encoded
                for e in r.edits if r.edits is not None else ():
                    tree.edit(_whole(e["at"]), _whole(e["cut"]), e["put"] or "")
                out.append((r.doc_id, before, tree.total, n_leaves, first, tree.encoded - first))
            yield pd.DataFrame(out, columns=["doc_id", "tokens_before", "tokens_after", "n_leaves", "chars_before", "chars_again"])

    return run


def recount(documents: DataFrame, edits: DataFrame, path: str | None = None, size: int = LEAF) -> DataFrame:
    """Token counts of every document before and after its edits (doc_id, no, at, cut, put)."""
    grouped = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("no", "at", "cut", "put"))).alias("edits"))
    grouped = grouped.withColumnRenamed("doc_id", "of")
    rows = documents.select("doc_id", "text").join(grouped, F.col("doc_id").eqNullSafe(F.col("of")), "left").drop("of")
    return _counted(rows, path, size)


def _counted(rows: DataFrame, path: str | None = None, size: int = LEAF) -> DataFrame:
    rows = rows.select(as_text("doc_id"), "text", "edits")
    return as_long(rows.mapInPandas(_recount(path, size), "doc_id string, tokens_before long, tokens_after long, n_leaves long, chars_before long, chars_again long"), "doc_id")


def derived_edits(documents: DataFrame) -> DataFrame:
    """documents with an array ``edits`` of three edits each, made of doc_id and length alone: a replacement in the middle, a deletion after a third, an insertion at the end."""
    size = F.length(F.coalesce("text", F.lit("")))
    edit = lambda no, at, cut, put: F.struct(F.lit(no).alias("no"), at.cast("int").alias("at"), F.lit(cut).alias("cut"), put.alias("put"))
    tag = F.concat(F.lit(" edit"), F.col("doc_id").cast("string"))
    return documents.select("doc_id", "text", F.array(edit(1, size / 2, 7, tag), edit(2, size / 3, 40, F.lit("")), edit(3, size, 0, F.coalesce(tag, F.lit("")))).alias("edits"))


def recount_derived(documents: DataFrame) -> DataFrame:
    return _counted(derived_edits(documents))
