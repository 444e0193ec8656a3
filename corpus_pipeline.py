"""Corpus cleaning in stages; each stage's result is written and read again as the next one's documents.

Toxic documents go; of each class of near copies the least doc_id stays (of several texts under it the one of the least hash); contaminated documents
go; live-looking secrets are masked; what is left is encoded. Every row is judged by its own text, also where rows share a doc_id. Rows with a null
doc_id have no near copies; the other stages treat them like all rows. Wholly repeated rows become one in the second stage.
"""

from __future__ import annotations

from tidebar import ship
from tidebar.llm import bpe, decontaminate, order_minhash, secret_scan, toxicity
from tidebar.llm.common import durable, table


def drop_toxic(spark, docs, sf_dir):
    ship(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark, docs, sf_dir):
    ship(spark)
    return order_minhash.keep_first(docs)


def drop_contaminated(spark, docs, sf_dir):
    ship(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark, docs, sf_dir):
    ship(spark)
    return secret_scan.redact(docs)


def encode(spark, docs, sf_dir):
    ship(spark)
    return bpe.with_digests(bpe.encoded_corpus(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("byte_level_bpe", encode),
]

#: A fitted classifier and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
