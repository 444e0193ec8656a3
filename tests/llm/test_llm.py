"""Each operator against brute force on small fixtures, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.llm import bpe, decontaminate, embedding_dedup, license_scan, order_minhash, secret_scan, token_counts, toxicity, unit_dedup, warc
from tidebar.llm.common import words_of

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, rid long, words string, id string, node long"


def docs(spark, texts, first=0):
    rows = [(i + first, t, "en", f"src{i % 3}", len(t or ""), 1, "w", "x", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, EXTRA)


def prose(seed, n=80):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


ODD = [None, "", "   \n ", "one", "\U0001f600 ünï " * 4]


def test_decontamination(spark):
    item = prose(1, 30)
    short = "tiny item of five words"
    texts = [*ODD, prose(2), prose(2) + " " + item, prose(3) + " " + " ".join(item.split()[3:16]), prose(4) + " " + short, item.upper(), item, item]
    bench = spark.createDataFrame([(7, item), (8, short), (9, None), (10, "")], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.contamination(docs(spark, texts), bench).collect()}
    windows = {tuple(item.split()[i : i + 13]): 7 for i in range(18)} | {tuple(short.split()): 8}
    for k, t in enumerate(texts):
        w, hit, ids = words_of(t), set(), set()
        for win, i in windows.items():
            for at in range(len(w) - len(win) + 1):
                if tuple(w[at : at + len(win)]) == win:
                    hit |= set(range(at, at + len(win)))
                    ids.add(i)
        want = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
        assert want == tuple(out[k])[1:]
    assert decontaminate.contamination(docs(spark, ["a"]).limit(0), bench).count() == 0


def test_bpe_equals_the_library(spark):
    texts = [*ODD, "x" * 9000, ("word's 12  \n\n" * 900), prose(5, 2000), prose(5, 2000), " \t" * 3000 + "end"]
    out = bpe.encode_documents(docs(spark, texts), chunk=1000, overlap=100).collect()
    assert len(out) == len(texts)
    enc = bpe.encoding()
    for r in out:
        t = texts[r.doc_id] or ""
        ids = np.array(enc.encode_ordinary(t), dtype="<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_secrets(spark):
    live, copied = "AKIA" + "Q7" * 8, "AKIA" + "Z9" * 8
    texts = [*ODD, f"key {live} end", *[f"see {copied}" for _ in range(6)], "Password = 'abc' token: abcdef1 " + "0a" * 12, "ghp_" + "a1B2" * 10]
    out = {r.doc_id: r for r in secret_scan.secrets(docs(spark, texts)).collect()}
    assert out[5].spans == "access:4:24" and out[5].n_live == 1
    assert out[6].n_copied == 1 and out[6].n_access == 1
    assert (out[12].n_assign, out[12].n_hex) == (1, 1)
    assert out[13].spans.startswith("github:0:") and out[13].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = {r.doc_id: r.text for r in secret_scan.redact(docs(spark, texts)).collect()}
    assert masked[5] == "key [secret] end" and masked[6] == texts[6] and masked[0] is None


def test_near_duplicates(spark):
    base = prose(9, 200).split()
    near, far = base[:], base[:]
    near[50] = "changed"
    for k in range(0, 200, 12):
        far[k] = f"other{k}"
    texts = [*ODD, " ".join(base), " ".join(near), " ".join(far), " ".join(base).upper(), prose(10, 200)]
    out = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs(spark, texts)).collect()}
    assert out[5] == out[6] == out[8] == 5 and out[7] == 7 and out[9] == 9
    assert out[0] == out[1] == out[2] == 0 and out[3] == 3


def test_alignment_equals_edit_distance():
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.randint(0, 3) for _ in range(r.randint(0, 9))] for _ in range(2))
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        for band in range(10):
            assert order_minhash.within_band(np.array(a), np.array(b), band) == (d[-1] <= band)


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    rows = [(k, (base[k % 40] + (0.02 * rng.normal(size=16) if k >= 40 else 0)).tolist(), k % 2) for k in range(160)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, base[0].tolist(), None), (204, [1.0], 1)]
    out = {r.vec_id: r for r in embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=16).collect()}
    x = np.array([r[1] for r in rows[:160]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.93
    near &= (np.arange(160)[:, None] % 2) == (np.arange(160)[None] % 2)
    assert [out[k].n_links for k in range(160)] == (near.sum(1) - 1).tolist()
    assert all(out[k].component_id == k % 40 for k in range(160))
    assert all(out[k].n_links == 0 and out[k].kept for k in range(200, 205))


def test_licenses(spark):
    texts = [*ODD, "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "CC BY-NC. cc by nc", prose(3), "mit and nothing"]
    out = [r for r in sorted(license_scan.licenses(docs(spark, texts)).collect())]
    assert (out[5].base_labels, out[5].n_base, out[5].first_word, out[5].score) == ("mit", 1, 1, 1.0)
    assert (out[6].base_labels, out[6].labels) == ("", "gpl-3")
    assert (out[7].n_base, out[7].first_word, out[7].last_word) == (2, 0, 3)
    assert out[8].labels == out[9].labels == "" and out[0].n_words == 0


def test_repeated_passages(spark):
    passage = "Passage one stands here for the test. " * 1 + "It holds more than ten words in all. Done so."
    texts = [*ODD, "Alpha beta gamma. " + passage + " omega", "delta epsilon " + passage, "Clean words of its own.", "Clean words of another kind."]
    out = unit_dedup.repeated_passages(docs(spark, texts)).collect()
    assert [(r.doc_id, r.kept_doc_ids) for r in out] == [(6, [5])]
    assert texts[6][out[0].start : out[0].end] == passage
    rest = {r.doc_id: r.text for r in unit_dedup.remove_repeats(docs(spark, texts)).collect()}
    assert rest[6] == "delta epsilon " and rest[5] == texts[5] and rest[0] is None


def test_edit_aware_counts(spark):
    enc = bpe.encoding()
    r = random.Random(2)
    for _ in range(60):
        text = prose(r.random(), r.randint(0, 300)) + "\n\n  " * r.randint(0, 2)
        tree = token_counts.Tree(text, lambda t: len(enc.encode_ordinary(t)), 60)
        for _ in range(5):
            at, cut, put = r.randint(0, len(text) + 5), r.randint(0, 90), r.choice(["", " ", "x", "\n\n", " new words 's", prose(1, 40)])
            tree.edit(at, cut, put)
            at = min(at, len(text))
            text = text[:at] + put + text[at + cut :]
            assert tree.total == len(enc.encode_ordinary(text))
    texts = [*ODD, prose(3, 900)]
    edits = spark.createDataFrame([(5, 1, 10, 5, "abc"), (1, 1, 0, 0, "new")], "doc_id long, no int, at int, cut int, put string")
    out = {x.doc_id: x for x in token_counts.recount(docs(spark, texts), edits).collect()}
    assert out[5].tokens_after == len(enc.encode_ordinary(texts[5][:10] + "abc" + texts[5][15:])) and out[5].chars_again < out[5].chars_before
    assert out[1].tokens_after == 1 and out[0].tokens_after == 0


def test_warc(spark):
    big = prose(1, 60)
    rows = [(1, "u", big), (2, "u", big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, None, "\r\n\r\nWARC/1.1\r\n" * 20), (8, "u", "é" * 2_000_000), (2, "u", big)]
    out = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows)
    html = {k: h or "" for k, _, h in rows}
    for r in out:
        b = html[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 1) if r.page_id == 2 else ("response", None))


def test_toxicity_scores_every_row(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxicity(d, labels).collect()
    assert len(rows) == d.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(docs(spark, ODD), labels.limit(0)).count() == len(ODD)


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_take_odd_rows(spark, stage):
    import corpus_pipeline

    d = docs(spark, [*ODD, prose(1), prose(1)]).select("doc_id", "text", "lang", "source", "n_chars")
    out = corpus_pipeline.STAGES[stage][1](spark, d, "/root/testdata/sf0.001")
    if stage < 4:
        assert out.columns == d.columns
    assert out.count() == (4 if stage == 1 else 7)


@pytest.mark.parametrize("stage", range(4))
def test_pipeline_stages_keep_clashing_columns(spark, stage):
    import corpus_pipeline

    names = ["rid", "cuts", "score", "whole", "kept_id", "bad_id", "words", "node"]
    d = docs(spark, [*ODD, prose(1)]).select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(f"own {n}").alias(n) for n in names])
    out = corpus_pipeline.STAGES[stage][1](spark, d, "/root/testdata/sf0.001")
    assert out.columns == d.columns
    rows = out.collect()
    assert rows and all(r[n] == f"own {n}" for r in rows for n in names)


def test_near_copies_stage_keeps_other_texts_of_an_id(spark):
    import corpus_pipeline

    d = docs(spark, [prose(1), prose(2)]).select("doc_id", "text", "lang", "source", "n_chars")
    d = d.unionByName(d).unionByName(d.where("doc_id = 0").withColumn("text", F.lit(prose(3))))
    assert corpus_pipeline.drop_near_copies(spark, d, "/root/testdata/sf0.001").count() == 3
