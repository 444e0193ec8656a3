"""Ids above 2**53 come back as they were beside a null, from every operator."""

import pytest

from tidebar.llm import bpe, decontaminate, license_scan, order_minhash, secret_scan, token_counts, toxicity, unit_dedup, warc

BIG = 2**53 + 1
TEXT = "Some passage of more than ten words that stands in two of the rows here. It goes on, token: abcdef123."


def rows(spark):
    return spark.createDataFrame([(None, "a null id"), (BIG, TEXT), (BIG + 2, "Before it. " + TEXT)], "doc_id long, text string").selectExpr("*", "'s' as source")


def apply(spark, name):
    d = rows(spark)
    labels = spark.createDataFrame([(BIG, 1), (None, 0)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, TEXT)], "item_id long, text string")
    return {
        "op2": lambda: toxicity.toxicity(d, labels),
        "op3": lambda: secret_scan.secrets(d),
        "op4": lambda: decontaminate.contamination(d, bench),
        "op5": lambda: order_minhash.near_duplicates(d),
        "op6": lambda: license_scan.licenses(d),
        "op7": lambda: token_counts.recount_derived(d),
        "op8": lambda: bpe.encode_documents(d, chunk=20, overlap=10),
    }[name]()


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op5", "op6", "op7", "op8"])
def test_ids_beside_a_null(spark, name):
    assert {r.doc_id for r in apply(spark, name).collect()} == {None, BIG, BIG + 2}


def test_ids_of_passages_and_pages(spark):
    assert [(r.doc_id, r.kept_doc_ids) for r in unit_dedup.repeated_passages(rows(spark)).collect()] == [(BIG + 2, [BIG])]
    html = "x" * 200
    pages = spark.createDataFrame([(None, "u", "other"), (BIG, "u", html), (BIG + 2, "u", html)], "page_id long, url string, html string")
    out = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert out == {None: ("response", None), BIG: ("response", None), BIG + 2: ("revisit", BIG)}


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_empty_tables(spark, name):
    d = rows(spark).limit(0)
    found = {
        "op2": lambda: toxicity.toxicity(d, spark.createDataFrame([], "doc_id long, toxic int")),
        "op3": lambda: secret_scan.secrets(d),
        "op4": lambda: decontaminate.contamination(d, spark.createDataFrame([], "item_id long, text string")),
        "op5": lambda: order_minhash.near_duplicates(d),
        "op6": lambda: license_scan.licenses(d),
        "op7": lambda: token_counts.recount_derived(d),
        "op8": lambda: bpe.encode_documents(d),
        "op9": lambda: unit_dedup.repeated_passages(d),
        "op10": lambda: warc.round_trip(d.selectExpr("doc_id as page_id", "text as html", "source as url")),
    }[name]()
    assert found.count() == 0


def test_owners_and_repositories_are_counted_apart(spark):
    key = "AKIA" + "Q7" * 8
    d = spark.createDataFrame([(k, key, f"repo{k}", "one") for k in range(5)], "doc_id long, text string, repo string, who string")
    found = secret_scan.scan(d, "repo", "who")
    assert [(r.n_repositories, r.n_owners, r.live) for r in secret_scan.ownership(found).collect()] == [(5, 1, True)]


def test_edits_with_nulls(spark):
    from tidebar.llm import token_counts

    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 1, None, 4, "x "), (1, 2, 3, None, "y"), (1, 3, None, None, None), (2, 1, None, None, "z")], "doc_id long, no int, at int, cut int, put string")
    got = {r.doc_id: r.tokens_after for r in token_counts.recount(docs, edits).collect()}
    count = lambda t: len(token_counts.encoding(None).encode_ordinary(t))
    assert got == {1: count("x tywo three"), 2: count("z")}
    assert token_counts.recount(docs.limit(0), edits).count() == 0
