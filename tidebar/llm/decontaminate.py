"""Benchmark decontamination by winnowing, in DataFrame operations only.

Both sides keep the least hash of K consecutive words in every window of
``window - K + 1`` such hashes. Texts that share ``window`` words share the least
hash of that stretch, so joining on the kept values misses no shared stretch of
that length. Hits are then extended: the stretches behind a joined value are
compared word for word with those of the benchmark.

Items shorter than ``window`` have no guaranteed fingerprint; they are looked up by
the place of their longest word and compared as a whole.

Defined results: null text has no words; items without words are ignored; repeated
rows each get their own result; other columns are ignored; empty tables give empty
results or results without hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable, small, words_column

K = 5


def _grams(words: Column, n: Column) -> Column:
    """Hashes of K consecutive words; for n >= K only."""
    return F.transform(F.sequence(F.lit(1), n - (K - 1)), lambda i: F.xxhash64(F.slice(words, i, K)))


def _least(grams: Column, window: int) -> Column:
    """For each window its least hash."""
    wide = window - K + 1
    return F.transform(F.sequence(F.lit(1), F.size(grams) - (wide - 1)), lambda i: F.array_min(F.slice(grams, i, wide)))


def _with_least(df: DataFrame, window: int) -> DataFrame:
    """Adds n (words) and least (array by window; empty if the text is shorter)."""
    df = df.withColumn("n", F.size("words"))
    df = df.withColumn("grams", F.when(F.col("n") >= window, _grams(F.col("words"), F.col("n"))))
    none = F.array().cast("array<bigint>")
    return df.withColumn("least", F.coalesce(F.when(F.col("n") >= window, _least(F.col("grams"), window)), none)).drop("grams")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """Per document the columns of judged(), but for the text's hash."""
    return judged(documents, benchmark, window, share).drop("text_hash")


def keep_clean(documents: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """The rows of documents that are not contaminated, with their own columns; rows that share a doc_id are judged each by its text."""
    bad = judged(documents, benchmark, window, share).where("contaminated").select(F.col("doc_id").alias("bad_id_"), F.col("text_hash").alias("bad_hash_")).distinct()
    same = (F.xxhash64("text") == F.col("bad_hash_")) & F.col("doc_id").eqNullSafe(F.col("bad_id_"))
    return documents.join(small(durable(bad)), same, "left_anti")


def judged(documents: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words).

    A document word is hit if it stands in an occurrence of ``window`` consecutive words of
    an item, or of a whole item that is shorter.
    """
    # a row is known by its doc_id and the hash of its text, so that texts are read twice but only those with a hit move
    key = ["doc_id", "text_hash"]
    texts = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    docs = texts.select(*key, words_column(F.col("text")).alias("words"))
    items = durable(benchmark.select("item_id", words_column(F.col("text")).alias("words")).where(F.size("words") > 0))
    base = durable(_with_least(docs, window).select(*key, F.col("n").cast("long").alias("n_words"), F.array_distinct("least").alias("values")))

    long_items = _with_least(items.where(F.size("words") >= window), window)
    prints = long_items.select(F.explode("least").alias("value")).distinct()
    met = base.select(*key, F.explode("values").alias("value")).join(small(prints), "value", "left_semi")
    met = met.select(*key, "value", F.lit(None).cast("struct<start:int,len:int>").alias("place"))
    short = items.where(F.size("words") < window)
    anchor = F.array_max(F.transform("words", lambda w, i: F.struct(F.length(w).alias("size"), w.alias("word"), i.alias("at"))))
    short = short.select(anchor.alias("a"), F.size("words").alias("len")).select("a.word", "a.at", "len").distinct()
    if not short.isEmpty():
        places = docs.select(*key, F.posexplode("words").alias("pos", "word")).join(small(short), "word")
        place = F.struct((F.col("pos") - F.col("at") + 1).alias("start"), F.col("len"))
        met = met.unionByName(places.select(*key, F.lit(None).cast("long").alias("value"), place.alias("place")))
    hit = durable(met.groupBy(*key).agg(F.collect_set("value").alias("hits"), F.collect_set("place").alias("short")))

    weight = hit.agg(F.coalesce(F.sum(F.size("hits") + F.size("short") + 4), F.lit(0))).first()[0]
    hit = hit.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "hits", "short")
    same = (F.col("text_hash") == F.col("hit_hash")) & F.col("doc_id").eqNullSafe(F.col("hit_id"))
    looked = texts.join(F.broadcast(hit) if weight <= BROADCAST_ROWS else hit, same)
    looked = looked.select(*key, words_column(F.col("text")).alias("words"), "hits", "short").withColumn("n", F.size("words"))
    wanted_values = (F.col("n") >= window) & (F.size("hits") > 0)
    looked = looked.withColumn("grams", F.when(wanted_values, _grams(F.col("words"), F.col("n"))))
    looked = looked.withColumn("least", F.when(wanted_values, _least(F.col("grams"), window)))
    wide = F.filter(
        F.transform("least", lambda v, i: F.struct((i + 1).alias("start"), F.lit(window).alias("len"), v.alias("v"))),
        lambda s: F.array_contains(F.col("hits"), s["v"]),
    )
    narrow = F.filter("short", lambda s: (s["start"] >= 1) & (s["start"] + s["len"] <= F.col("n") + 1))
    phrase = lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len"), F.array_join(F.slice("words", s["start"], s["len"]), " ").alias("phrase"))
    empty = F.array().cast("array<struct<start:int,len:int,phrase:string>>")
    cand = F.concat(F.coalesce(F.transform(wide, phrase), empty), F.coalesce(F.transform(narrow, phrase), empty))
    looked = durable(looked.select(*key, F.explode(cand).alias("c")).select(*key, "c.*"))

    stretches = F.when(F.size("words") < window, F.array(F.array_join("words", " "))).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1))), lambda i: F.array_join(F.slice("words", i, window), " "))
    )
    wanted = items.select("item_id", F.explode(stretches).alias("phrase")).distinct()
    found = looked.join(small(wanted), "phrase")
    found = found.groupBy(*key).agg(F.collect_set(F.struct("start", "len")).alias("at"), F.collect_set("item_id").alias("ids"))
    covered = F.array_distinct(F.flatten(F.transform("at", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))
    found = durable(
        found.select(
            F.col("doc_id").alias("hit_id"),
            F.col("text_hash").alias("hit_hash"),
            F.size(covered).cast("long").alias("hit"),
            F.size("ids").cast("long").alias("items"),
            F.sha2(F.array_join(F.array_sort(F.transform("ids", lambda x: x.cast("string"))), ","), 256).alias("sha"),
        )
    )
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    return base.drop("values").join(small(found), same, "left").select(
        "doc_id",
        "text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )
