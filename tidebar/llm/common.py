"""Pieces that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What separates words: every ASCII character but digits and a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

#: Rows of a side that may be broadcast; a counted bound, about 16 MB of thin rows.
BROADCAST_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where a local session, as in tests, names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def durable(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again; cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_text(name: str):
    """An id as a string: a null beside it would turn integers into floats in pandas, which rounds those above 2**53."""
    return F.col(name).cast("string").alias(name)


def as_long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that df does not have, whatever extra columns it carries."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count shows that it has no more than that many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def words_column(text: Column) -> Column:
    """The words of a text as an array; null counts as empty."""
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(folded, SEPARATORS), "")


def word_bytes(text: str | None) -> list[bytes]:
    """The same words in UTF-8: letters beyond ASCII have bytes over 127 only, so a table of bytes folds and cuts."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def words_of(text: str | None) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in word_bytes(text)]
