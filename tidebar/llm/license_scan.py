"""Licence scan by a positional index of rare licence words, in DataFrame operations only.

The document frequency of every licence word is counted over the whole corpus. Each template is indexed by its rarest words; all of a
file's words that are in the index are looked up in the templates' postings; postings that agree on where the template would start
name a candidate, and a candidate stands if its mandatory phrases are there and enough of its
words stand at their places. No word of the index is left out, so no place of a base phrase and no template that holds one of its
own words in place is missed.

Defined results: null texts are empty; repeated rows each get a row; other columns are ignored; an empty table gives an
empty result. score is the best share of a template's words in place, 0 without a label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words_column

#: The base phrases, and licence openings with their mandatory phrases.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    "apache-2": ("licensed under the apache license version 2 0 the license", "apache license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    "gpl-2": ("gnu general public license version 2", "gnu general public license version 2"),
    "gpl-3": ("gnu general public license version 3", "gnu general public license version 3"),
    "lgpl": ("gnu lesser general public license", "gnu lesser general public license"),
    "mpl-2": ("subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    "cc-by": ("creative commons attribution 4 0 international license", "creative commons attribution"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "unencumbered software"),
}
SHARE = 0.8


def _entries() -> list[tuple[str, list[str], str, bool]]:
    """(label, words, mandatory phrase, is base)"""
    base = [(k, p.split(), p, True) for k, p in BASE.items()]
    return base + [(k, t.split(), must, False) for k, (t, must) in TEMPLATES.items()]


def frequencies(words: DataFrame) -> dict[str, int]:
    """In how many rows each licence word stands; as many entries as the templates have words."""
    vocabulary = sorted({w for _, ws, _, _ in _entries() for w in ws})
    own = F.array_intersect("words", F.array(*map(F.lit, vocabulary)))
    counted = words.select(F.explode(own).alias("word")).groupBy("word").count()
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in counted.collect()}


def licenses(documents: DataFrame) -> DataFrame:
    """Per row: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = documents.select("doc_id", words_column(F.col("text")).alias("words"))
    seen, entries = frequencies(words), _entries()
    rare_first = sorted(seen, key=lambda w: (seen[w], w))
    rank = {w: k for k, w in enumerate(rare_first)}
    # each template is looked up by its rarest words; a base phrase by its rarest alone
    postings: dict[str, list[tuple[int, int]]] = {}
    for no, (_, ws, _, base) in enumerate(entries):
        chosen = sorted(set(ws), key=rank.get)[: 1 if base else 3]
        for at, w in enumerate(ws):
            if w in chosen:
                postings.setdefault(w, []).append((no, at))
    anchors = sorted(postings, key=rank.get)
    listed = F.array(*map(F.lit, anchors))
    post = F.create_map(*[x for w in anchors for x in (F.lit(w), F.array(*[F.struct(F.lit(no).alias("no"), F.lit(at).alias("at")) for no, at in postings[w]]))])
    table = F.array(*[F.struct(F.array(*map(F.lit, ws)).alias("words"), F.lit(f" {must} ").alias("must"), F.lit(label).alias("label"), F.lit(base).alias("base")) for label, ws, must, base in entries])
    spots = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: F.array_contains(listed, s["w"]))
    starts = F.array_distinct(F.flatten(F.transform("spots", lambda s: F.transform(F.element_at(post, s["w"]), lambda p: F.struct(p["no"].alias("no"), (s["i"] - p["at"]).alias("start"))))))

    def placed(c):
        entry = F.element_at(table, c["no"] + 1)
        skip = F.greatest(-c["start"], F.lit(0))
        there = F.slice("words", F.greatest(c["start"], F.lit(0)) + 1, F.greatest(F.size(entry["words"]) - skip, F.lit(0)))
        same = F.size(F.filter(F.zip_with(F.slice(entry["words"], skip + 1, F.greatest(F.size(entry["words"]) - skip, F.lit(1))), there, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
        text = F.concat(F.lit(" "), F.array_join(there, " "), F.lit(" "))
        return F.struct(entry["label"].alias("label"), entry["base"].alias("base"), c["start"].alias("start"), (same / F.size(entry["words"])).alias("share"), text.contains(entry["must"]).alias("must"))

    df = words.withColumn("some", F.arrays_overlap("words", listed))
    df = df.withColumn("spots", F.when(F.col("some"), spots))
    df = df.withColumn("starts", F.when(F.col("some"), starts))
    df = df.withColumn("found", F.transform("starts", placed))
    df = df.withColumn("found", F.filter("found", lambda f: f["must"] & (f["share"] >= F.when(f["base"], 1.0).otherwise(SHARE))))
    none = F.array().cast("array<struct<label:string,base:boolean,start:int,share:double,must:boolean>>")
    df = df.select("doc_id", F.size("words").cast("long").alias("n_words"), F.coalesce("found", none).alias("found"))
    df = df.withColumn("base", F.filter("found", lambda f: f["base"]))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda f: f["label"]))), ",")
    at = F.transform("base", lambda f: f["start"].cast("long"))
    return df.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        names("base").alias("base_labels"),
        names("found").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0)).alias("score"),
    )
