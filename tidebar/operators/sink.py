"""An append-only table that takes every batch once: for replayed micro-batches, and for several writers at a time.

Rows are written to a folder of their own first and are not part of the table. They become part of it by a commit record, a small file with the next number, which only one writer can
put in place; it names the batch and the folder. A batch whose id has a record is not written again. A writer that loses the race for a number judges its rows anew against what the winner
wrote, and tries the next one. Readers see committed folders alone, so a writer that dies leaves nothing but a folder that ``vacuum`` removes.

Rows whose key is stored with the same values are no change; with other values they are refused, and with them the whole batch. Rows that are not closed are left out.
The record is put in place by a rename that does not overwrite, which is atomic on HDFS; a store without that needs another way to put a file in place once.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import new_rows

ATTEMPTS = 50


class _Files:
    """Small files beside a table, through Hadoop, wherever the table is."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), spark._jsc.hadoopConfiguration())
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put_once(self, name: str, text: str) -> bool:
        """Whether this call put the file in place; it is there whole or not at all."""
        draft = self.path(f".{uuid.uuid4().hex}")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(self.path(name).getParent())
        none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
        options[0] = none
        try:
            self.context.rename(draft, self.path(name), options)
        except Exception as e:
            if "FileAlreadyExists" not in str(e) and not self.fs.exists(self.path(name)):
                raise
            self.fs.delete(draft, False)
            return False
        return self.read(name) == text

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def commits(spark: SparkSession, path: str) -> list[dict]:
    """The records in order: number, batch, folder (null where the batch held nothing new), rows."""
    files = _Files(spark, path)
    return [json.loads(files.read(f"commits/{n}")) for n in files.names("commits") if n.endswith(".json")]


def load(spark: SparkSession, path: str, schema, upto: int | None = None) -> DataFrame:
    """The table's rows; with ``upto``, as they were after the record of that number."""
    found = [c for c in commits(spark, path) if upto is None or c["number"] <= upto]
    folders = [f"{path}/data/{c['folder']}" for c in found if c["folder"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def append(path: str, incoming: DataFrame, key: list[str], batch: str, closed: str = "is_closed") -> int:
    """Rows written: 0 for a batch that is there. Values that differ under a stored key raise ImmutableConflict and write nothing."""
    spark, files = incoming.sparkSession, _Files(incoming.sparkSession, path)
    if closed in incoming.columns:
        incoming = incoming.where(F.col(closed)).drop(closed)
    incoming = incoming.persist()
    try:
        for _ in range(ATTEMPTS):
            found = commits(spark, path)
            if any(c["batch"] == batch for c in found):
                return 0
            fresh = new_rows(load(spark, path, incoming.schema, len(found) - 1), incoming, key)
            folder = f"part-{uuid.uuid4().hex}"
            fresh.write.parquet(f"{path}/data/{folder}")
            rows = spark.read.schema(incoming.schema).parquet(f"{path}/data/{folder}").count()
            record = {"number": len(found), "batch": batch, "folder": folder if rows else None, "rows": rows}
            if files.put_once(f"commits/{len(found):010d}.json", json.dumps(record)):
                return rows
            files.remove(f"data/{folder}")
            time.sleep(0.05)
        raise TimeoutError(f"no record could be put in place for {batch}")
    finally:
        incoming.unpersist()


def batch_writer(path: str, key: list[str], stream: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch; ``stream`` names the query, whose batch ids are its own."""

    def write(df: DataFrame, batch_id: int) -> None:
        append(path, df, key, f"{stream}:{batch_id}")

    return write


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Removes folders without a record; not to be run beside writers."""
    files, kept = _Files(spark, path), {c["folder"] for c in commits(spark, path)}
    gone = [f for f in files.names("data") if f not in kept]
    for f in gone:
        files.remove(f"data/{f}")
    return gone
