"""Whole short lines, and passages inside long sentences."""

import random

from tidebar.llm import unit_dedup

DOCS = "doc_id long, text string"


def sentence(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def test_whole_short_lines(spark):
    texts = ["Read more here\nalpha beta. Read more there", "own words\nread  more here\nother words", "In one read more here line", "own WORDS. Yes.\nNo. Yes"]
    out = unit_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    # no line but the repeated one, and no short fragment of a line
    assert [(r.doc_id, texts[r.doc_id][r.start : r.end], r.n_words, r.kept_doc_ids) for r in out] == [(1, "read  more here", 3, [0])]


def test_a_passage_inside_long_sentences(spark):
    shared = sentence(1, 60)
    texts = [f"{sentence(2, 33)} {shared} {sentence(3, 21)}", f"{sentence(4, 14)} {shared} {sentence(5, 40)}"]
    out = unit_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert len(out) == 1 and out[0].doc_id == 1 and out[0].kept_doc_ids == [0] and out[0].n_words >= 40
    assert texts[1][out[0].start : out[0].end] in shared


def test_units_are_in_order_and_whole():
    text = f"{sentence(7, 50)}\n\nOne two. Three\n  \n{sentence(8, 9)}"
    found = unit_dedup.units(text)
    own = [u for u in found if not u[5]]
    assert [u[0] for u in own] == list(range(len(own)))
    assert " ".join(" ".join(text[a:b] for _, a, b, *_ in own).split()) == " ".join(text.split())
    assert [text[a:b] for _, a, b, _, _, line in found if line] == ["One two. Three", sentence(8, 9)]


def test_rows_without_an_id_keep_nothing_that_others_have(spark):
    shared, alone = sentence(31, 30), sentence(32, 30)
    rows = [(None, f"{shared}\n{alone}"), (5, shared), (3, shared), (None, alone)]
    out = unit_dedup.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r.doc_id), r.kept_doc_ids) for r in out) == [("5", [3]), ("None", []), ("None", [3])]
