"""Secret scan with corpus-wide ownership.

Every whole text is searched for the base kinds and for more kinds of token. The hash of each candidate's
value is counted by distinct repositories and owners over the corpus: a value
that many owners have is a widely copied example, one that a single or few owners have looks live. The spans
of the further kinds are added where their value is owner-specific; base spans always stay.

Where a table has no separate owner, the source stands for repository and owner.
Defined results: null texts count as empty; repeated rows each get a row; a null source is one
owner of its own; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, as_text, durable, small, unused

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Further kinds of credential, by their documented public prefixes.
FURTHER = {
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
}
BASE = ("assign", "access", "hex")
SPAN = "struct<kind:string,start:int,end:int,hash:string,base:boolean>"


def candidates(text: str | None) -> list[tuple[str, int, int, str, bool]]:
    """(kind, start, end, hash of the value, is base) by start and kind; code points, end exclusive."""
    if not text:
        return []
    found = [("assign", m.start(), m.end(), m[2], True) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0], True) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end(), m[0], True) for m in HEX.finditer(text)]
    for kind, pattern in FURTHER.items():
        found += [(kind, m.start(), m.end(), m[0], False) for m in pattern.finditer(text)]
    order = [*BASE, *FURTHER]
    found.sort(key=lambda x: (x[1], order.index(x[0])))
    return [(k, a, b, hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest(), base) for k, a, b, v, base in found]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [candidates(t) for t in pdf["text"]]
        yield pd.DataFrame({"rid": pdf["rid"], "doc_id": pdf["doc_id"], "repository": pdf["repository"], "owner": pdf["owner"], "found": [[dict(zip(("kind", "start", "end", "hash", "base"), x, strict=True)) for x in f] for f in found]})


def scan(documents: DataFrame, repository: str = "source", owner: str = "source") -> DataFrame:
    """rid, doc_id, found (base and further spans) for every row; durable."""
    return _scanned(documents.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col(repository).alias("repository"), F.col(owner).alias("owner"), "text"))


def _scanned(docs: DataFrame) -> DataFrame:
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select("rid", as_text("doc_id"), none("repository"), none("owner"), "text")
    return durable(as_long(docs.mapInPandas(_scan, f"rid long, doc_id string, repository string, owner string, found array<{SPAN}>"), "doc_id"))


def ownership(found: DataFrame, few: int = 2) -> DataFrame:
    """hash, n_repositories, n_owners, live: by distinct pairs first, so that a hash of many rows is counted in parts.

    A value is live-looking if few owners have it: its repositories may be many, as one owner can use a credential in all of theirs.
    """
    each = found.select("repository", "owner", F.explode("found").alias("s")).select(F.col("s.hash").alias("hash"), "repository", "owner").distinct()
    counted = each.groupBy("hash").agg(F.count_distinct("repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"))
    return counted.withColumn("live", F.col("n_owners") <= few)


def secrets(documents: DataFrame, few: int = 2, repository: str = "source", owner: str = "source") -> DataFrame:
    """Per row: rid, doc_id, counts, base_sha256, spans, n_live, n_copied and the spans as an array (all_spans)."""
    found = scan(documents, repository, owner)
    spans = found.select("rid", F.explode("found").alias("s")).select("rid", "s.*")
    spans = spans.join(small(ownership(found, few)), "hash").where(F.col("base") | F.col("live"))
    order = F.array_position(F.array(*map(F.lit, (*BASE, *FURTHER))), F.col("kind")).cast("int")
    by_row = spans.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "kind", "end", "base", "live"))).alias("all_spans"))
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int,base:boolean,live:boolean>>")
    rows = found.drop("found", "repository", "owner").join(by_row, "rid", "left").withColumn("all_spans", F.coalesce("all_spans", none))
    said = lambda arr: F.array_join(F.transform(arr, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda test: F.size(F.filter("all_spans", test)).cast("long")
    return rows.select(
        "rid",
        "doc_id",
        *[n(_is(k)).alias(f"n_{k}") for k in BASE],
        F.sha2(said(F.filter("all_spans", lambda s: s["base"])), 256).alias("base_sha256"),
        said(F.col("all_spans")).alias("spans"),
        n(lambda s: s["live"]).alias("n_live"),
        n(lambda s: ~s["live"]).alias("n_copied"),
        "all_spans",
    )


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _found(texts: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("kind", "start", "end", "hash", "base"), x, strict=True)) for x in candidates(t)] for t in texts], dtype=object)


def redact(documents: DataFrame, few: int = 2, mark: str = "[secret]") -> DataFrame:
    """documents with every live-looking span of its text replaced; n_chars follows the text. Only rows with a candidate are joined."""
    rid, found, cuts = unused(documents, "rid", "found", "cuts")
    keyed = durable(documents.withColumn(rid, F.monotonically_increasing_id()).withColumn(found, F.pandas_udf(_found, f"array<{SPAN}>")("text")))
    some, rest = keyed.where(F.size(found) > 0), keyed.where(F.size(found) == 0)
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    own = some.select(F.col(rid).alias("rid"), source.alias("repository"), source.alias("owner"), F.col(found).alias("found"))
    live = small(durable(ownership(own, few).where("live").select("hash")))
    spans = own.select("rid", F.explode("found").alias("s")).select("rid", "s.*").join(live, "hash")
    spans = spans.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cuts")).toDF(rid, cuts)
    masked = some.join(spans, rid, "left").withColumn("text", F.coalesce(_masked(mark)("text", cuts), F.col("text")))
    if "n_chars" in documents.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return masked.select(*documents.columns).unionByName(rest.select(*documents.columns))


def _masked(mark: str):
    @F.pandas_udf("string")
    def cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, cuts, strict=True):
            if spans is None or text is None:
                out.append(None if spans is None else text)
                continue
            done, parts = 0, []
            for s in spans:
                if s["start"] >= done:
                    parts += [text[done : s["start"]], mark]
                done = max(done, s["end"])
            out.append("".join([*parts, text[done:]]))
        return pd.Series(out, dtype=object)

    return cut
