"""Byte-level BPE by overlapping chunks.

Texts of more than ``chunk`` characters are dealt out as overlapping chunks. Each chunk is
split into pre-tokens by itself; where neighbours have a boundary in common inside their
overlap, they agree from there on, so the text is cut at the first such place. The
pieces are encoded in parallel and their bytes put together by document. Chunks without a
common boundary stay together as one piece. The rows hold the ids and the decoded bytes; counts and digests are derived from them.

Defined results: null and empty texts have no tokens; repeated rows each get a row;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_long, as_text

CHUNK, OVERLAP = 24_576, 1_024
RANKS = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoding(path: str | None = None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def packed(path: str | None, text: str) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    return np.asarray(encoding(path).encode_ordinary(text), dtype="<u4").tobytes()


def unpacked(path: str | None, ids: bytes) -> bytes:
    """The text's bytes: those of the ids, one after another."""
    return encoding(path).decode_bytes(np.frombuffer(ids, dtype="<u4").tolist())


def _whole(path: str | None):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                ids = [packed(path, t or "") for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "ids": ids, "decoded": [unpacked(path, x) for x in ids]})

    return encode


def _boundaries(overlap: int):
    """left and right: the boundaries that a chunk sees in its first and last overlap, but for its last pre-token's."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            left, right = [], []
            for text, start in zip(pdf["part"], pdf["start"], strict=True):
                # after a run of white space the last pre-token depends on what follows, so only a change to white space counts
                at = [m.start() for m in _pattern().finditer(text)][:-1]
                at = [x for x in at if x and text[x].isspace() and not text[x - 1].isspace()]
                left.append([start + x for x in at if 0 < x < overlap])
                right.append([start + x for x in at if x >= len(text) - overlap])
            yield pdf.assign(left=left, right=right)

    return split


def _pieces(path: str | None):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = [packed(path, t) for t in pdf["text"]]
            yield pdf.drop(columns="text").assign(ids=ids, bytes=[unpacked(path, x) for x in ids])

    return encode


def encoded_corpus(documents: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers, one after another), decoded (the bytes that the ids stand for) for every row."""
    docs = documents.select(as_text("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = "doc_id string, ids binary, decoded binary"
    whole = docs.where(F.length("text") <= chunk).mapInPandas(_whole(path), out)

    long = docs.where(F.length("text") > chunk).groupBy("doc_id", "text").agg(F.count("*").alias("times"))
    long = long.withColumn("size", F.length("text")).withColumn("key", F.sha2("text", 256))
    parts = long.select("doc_id", "key", "times", "size", "text", F.explode(F.sequence(F.lit(0), F.expr(f"int((size - 1) div {chunk})"))).alias("no"))
    parts = parts.select("doc_id", "key", "times", "no", (F.col("no") * chunk).alias("start"), F.expr(f"substring(text, no * {chunk} + 1, {chunk + overlap})").alias("part"))
    kinds = "doc_id string, key string, times long, no int, start int, part string"
    parts = parts.mapInPandas(_boundaries(overlap), kinds + ", left array<int>, right array<int>")
    by = Window.partitionBy("doc_id", "key").orderBy("no")
    met = F.array_min(F.array_intersect(F.lag("right").over(by), F.col("left")))
    parts = parts.withColumn("cut", F.when(F.col("no") == 0, 0).otherwise(met))
    parts = parts.withColumn("stop", F.lead("cut").over(by)).withColumn("last", F.lead("no").over(by).isNull())
    parts = parts.withColumn("piece", F.count("cut").over(by))
    own = F.coalesce("cut", "start")
    until = F.when(F.col("last"), own + F.length("part")).otherwise(F.coalesce("stop", F.col("start") + chunk))
    parts = parts.withColumn("own", F.substring("part", own - F.col("start") + 1, until - own))
    pieces = parts.groupBy("doc_id", "key", "times", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "own"))), lambda x: x["own"]), "").alias("text"))
    pieces = pieces.mapInPandas(_pieces(path), "doc_id string, key string, times long, piece long, ids binary, bytes binary")
    joined = pieces.groupBy("doc_id", "key", "times").agg(F.array_sort(F.collect_list(F.struct("piece", "ids", "bytes"))).alias("p"))
    fold = lambda name: F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x[name]))
    joined = joined.select("doc_id", fold("ids").alias("ids"), fold("bytes").alias("decoded"), F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("x")).drop("x")
    return as_long(whole.unionByName(joined), "doc_id")


def with_digests(corpus: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 beside an encoded corpus' own columns."""
    count = F.expr("int(octet_length(ids) div 4)").cast("long")
    return corpus.select("*", count.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def encode_documents(documents: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row, of the encoded corpus."""
    return with_digests(encoded_corpus(documents, path, chunk, overlap)).drop("ids", "decoded")
