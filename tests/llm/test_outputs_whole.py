"""Ids, decoded bytes and payload chunks are rows."""

import hashlib
import random

import numpy as np

from tidebar.llm import bpe, warc

DOCS = "doc_id long, text string"


def sentence(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def test_ids_and_decoded_bytes_are_rows(spark):
    texts = [None, "", "one two", sentence(3, 900), sentence(3, 900)]
    corpus = bpe.encoded_corpus(spark.createDataFrame(list(enumerate(texts)), DOCS), chunk=1000, overlap=100)
    enc = bpe.encoding()
    for r in corpus.collect():
        t = texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(t) and bytes(r.decoded) == t.encode()


def test_the_last_stage_gives_the_encoded_corpus(spark):
    import corpus_pipeline

    r = corpus_pipeline.encode(spark, spark.createDataFrame([(1, "one two")], DOCS), None).first()
    assert bytes(r.decoded) == b"one two" and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()


def test_chunks_give_the_payload_back(spark, tmp_path):
    html = {1: "é" * 1_500_000, 2: "short", 3: None}
    pages = spark.createDataFrame([(k, "u", h) for k, h in html.items()], "page_id long, url string, html string")
    found = {}
    for r in sorted(warc.read_archives(warc.write_archives(pages, str(tmp_path))).collect(), key=lambda r: r.chunk_no):
        found[r.page_id] = found.get(r.page_id, b"") + bytes(r.chunk)
    assert found == {k: (h or "").encode() for k, h in html.items()}
