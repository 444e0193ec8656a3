"""WARC archives as a chunked record table.

Writing: every task streams its rows into one archive, a gzip member per record, payloads chunk by chunk. Archives get an attempt's own
name, are renamed when complete, and only those that a finished task reported are read, so a task that
runs again leaves nothing half done. Reading: archives are streamed into rows of record
identifier, chunk number and the chunk's bytes; sizes and digests are folded from these rows. No payload is held whole.

The folder must be one that driver and executors share and that a path opens: the one of spark.checkpoint.dir by default.
Equal payloads of at least ``least`` bytes: the smallest page_id is the response, the
others are revisits. Rows that repeat that page_id are responses too. Null payloads are
empty; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import datetime
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_long, as_text, durable, shared_dir

CHUNK = 1 << 20
RECORD = "archive string, record_no long, chunk_no int, page_id long, record_type string, refers_to long, full_bytes long, full_digest string, chunk binary, last boolean"
PAGES = ("page_id", "refers_to")
_TEXT = RECORD.replace("page_id long", "page_id string").replace("refers_to long", "refers_to string")


def _header(page_id: str | None, url: str, kind: str, refers: str | None, size: int, digest: str, length: int, date: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {date}", f"WARC-Record-ID: <urn:page:{page_id or ''}>", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, "Content-Type: text/html; charset=utf-8", f"Content-Length: {length}", "", ""]).encode("utf-8", "replace")


def _writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, n = f"{folder}/{uuid.uuid4().hex}", 0
        date = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        with open(name, "wb") as out:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    body = memoryview(r.payload) if r.record_type == "response" else memoryview(b"")
                    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(gz.compress(_header(r.page_id, r.url, r.record_type, r.refers_to, r.size, r.digest, len(body), date)))
                    for at in range(0, len(body), CHUNK):
                        out.write(gz.compress(body[at : at + CHUNK]))
                    out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                    n += 1
        if n:
            os.replace(name, f"{name}.warc.gz")
            yield pd.DataFrame({"archive": [f"{name}.warc.gz"], "records": [n]})
        else:
            os.remove(name)

    return write


def _inflated(path: str) -> Iterator[bytes]:
    with open(path, "rb") as f:
        gz = zlib.decompressobj(31)
        while data := f.read(CHUNK):
            while data:
                if got := gz.decompress(data, CHUNK):
                    yield got
                data = gz.unconsumed_tail or gz.unused_data
                if gz.eof:
                    gz = zlib.decompressobj(31)


def records(path: str) -> Iterator[tuple]:
    """Rows of RECORD, streamed."""
    buffer, source, no = bytearray(), _inflated(path), 0
    while True:
        while b"\r\n\r\n" not in buffer:
            more = next(source, None)
            if more is None:
                return
            buffer += more
        head, _, rest = bytes(buffer).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
        buffer, left, chunk = bytearray(rest), int(fields["Content-Length"]), 0
        page = lambda k: fields.get(k, "").removeprefix("<urn:page:").rstrip(">") or None
        while True:
            while not buffer and left:
                buffer += next(source)
            part = bytes(buffer[: min(left, CHUNK)])
            del buffer[: len(part)]
            left -= len(part)
            yield (path, no, chunk, page("WARC-Record-ID"), fields["WARC-Type"], page("WARC-Refers-To"), int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"), part, not left)
            chunk += 1
            if not left:
                break
        while len(buffer) < 4:
            buffer += next(source)
        del buffer[:4]
        no += 1


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    for pdf in batches:
        for path in pdf["archive"]:
            rows, held = [], 0
            for row in records(path):
                rows.append(row)
                held += len(row[-2])
                if len(rows) == 2000 or held >= 8 * CHUNK:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each record; a record's chunks follow one another in a task, across its batches."""
    size, digest = 0, hashlib.sha256()
    for pdf in batches:
        own = []
        for chunk, last in zip(pdf["chunk"], pdf["last"], strict=True):
            size += len(chunk)
            digest.update(chunk)
            if last:
                own.append((size, digest.hexdigest()))
                size, digest = 0, hashlib.sha256()
        ends = pdf[pdf["last"].astype(bool)].drop(columns=["chunk", "last"])
        yield ends.assign(n_bytes=[n for n, _ in own], digest=[d for _, d in own])


def payloads(rows: DataFrame) -> DataFrame:
    """Each record of a chunked record table, as read_archives gives it, with the size and digest of its chunks put together."""
    rows = rows.withColumns({n: F.col(n).cast("string") for n in PAGES})
    return as_long(rows.mapInPandas(_folded, _TEXT.removesuffix(", chunk binary, last boolean") + ", n_bytes long, digest string"), *PAGES)


def roles(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id and digest of the rows that are revisits, with refers_to; only digests move, never payloads."""
    prints = pages.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size")).where(F.col("size") >= least)
    firsts = prints.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    return prints.join(firsts, "digest").where(F.col("page_id") > F.col("first")).select(F.col("page_id").alias("id"), F.col("digest").alias("same"), F.col("first").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """One row for each archive written."""
    pages = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = pages.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    rows = rows.join(roles(pages, least), (F.col("page_id") == F.col("id")) & (F.col("digest") == F.col("same")), "left")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type")
    rows = rows.select(as_text("page_id"), "url", kind, as_text("refers_to"), "size", "digest", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"))
    return durable(rows.mapInPandas(_writer(folder), "archive string, records long"))


def read_archives(archives: DataFrame) -> DataFrame:
    """The chunked record table; each archive is its own unit of work."""
    n = max(1, archives.count())
    return archives.select("archive").repartition(n, "archive").mapInPandas(_reader, _TEXT).transform(as_long, *PAGES)


def archive_folder(spark: SparkSession) -> str:
    shared = shared_dir(spark).removeprefix("file://")
    if "://" in shared:
        raise ValueError(f"archives are opened by path; {shared} is none: give a folder that is mounted on driver and executors")
    folder = f"{shared}/warc-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back."""
    folder = folder or archive_folder(pages.sparkSession)
    rows = payloads(read_archives(write_archives(pages, folder)))
    own = F.col("record_type") == "response"
    return rows.select("page_id", F.when(own, F.col("n_bytes")).otherwise(F.col("full_bytes")).alias("payload_bytes"), F.when(own, F.col("digest")).otherwise(F.col("full_digest")).alias("payload_digest"), "record_type", "refers_to")
