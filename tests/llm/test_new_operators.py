"""Lexical search, importance draws and quality rules against brute force, with nulls, ties, repeats, empty and long texts and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from oracle import differences
from pyspark.sql import functions as F
from test_llm import EXTRA, ODD, docs, prose

from tidebar.llm import importance_sample, lexical_search, quality_rules
from tidebar.llm import queries as llm
from tidebar.llm.common import words_of

SMALL = "/root/testdata/sf0.001"


def drawn(seed, n, kinds=60):
    r = random.Random(seed)
    return " ".join(f"w{min(int(r.expovariate(0.08)), kinds)}" for _ in range(n))


def texts_of(n=300):
    return [*ODD, *(drawn(i, 3 + i % 90) for i in range(n)), *[drawn(7, 40)] * 5, "w1 " * 30000]


def ranking(texts, query, k):
    words = [words_of(t) for t in texts]
    n_all, total = sum(bool(w) for w in words), sum(map(len, words))
    tfs = [Counter(w) for w in words]
    out = []
    for no, tf in enumerate(tfs):
        score = 0
        for t in set(words_of(query)):
            df = sum(t in x for x in tfs)
            if tf[t]:
                w = math.floor(1000 * math.log((2 * n_all + 2) / (2 * df + 1)))
                m = 50 + 50 * len(words[no]) * n_all // total
                score += w * (1000000000 * tf[t] // (1000 * tf[t] + 20 * m))
        if score:
            out.append((-score, no))
    return [(no, -s) for s, no in sorted(out)[:k]]


@pytest.mark.parametrize(("k", "terms"), [(50, 100_000), (3, 12)])
def test_search_equals_a_full_ranking(spark, k, terms):
    texts = texts_of()
    queries = [(1, drawn(3, 8)), (2, "w0 W0 w55"), (3, None), (4, "nowhere"), (1, "w17 w18"), (None, "w2"), (5, drawn(9, 25))]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in queries], "item_id long, text string, term string, rank long")
    got = {}
    for r in lexical_search.search(docs(spark, texts).repartition(5, "doc_id"), table, k, terms).collect():
        got.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    for item in {i for i, _ in queries}:
        want = ranking(texts, " ".join(t or "" for i, t in queries if i == item), k)
        assert sorted(got.get(item, [])) == [(no, d, s) for no, (d, s) in enumerate(want, 1)]


def test_search_of_empty_sides(spark):
    some, none = docs(spark, ["a b"]), docs(spark, ["a"]).limit(0)
    queries = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(none, queries).count() == lexical_search.search(some, queries.limit(0)).count() == 0
    # one document and one term: ln(4 / 3) is above 0
    assert [(r.item_id, r.rank, r.doc_id) for r in lexical_search.search(some, queries).collect()] == [(1, 1, 0)]


def test_threshold_prunes_lists(spark):
    """Rare terms carry the query, so entries of the common one stay below its threshold."""
    plan = {0: [(0, 5000, 200, 999_999), (1, 10, 100_000, 999_999)]}
    pdf = pd.DataFrame({"block": [3, 3], "term": [0, 1], "at": [np.array([4, 9]), np.array([9, 4, 7])], "impact": [np.array([900_000, 100]), np.array([500_000, 99_999, 5])]})
    out = lexical_search._sums(plan, {}, 5)(pdf)
    # document 9: its entry of term 0 lies below the threshold; 4: that of term 1
    assert sorted(map(tuple, out.itertuples(index=False))) == [(0, 3, 4, 4_500_000_000, 4_500_999_999), (0, 3, 9, 5_000_000, 5_999_999)]


def test_tournament_merges_and_stops():
    r = random.Random(1)
    for trial in range(30):
        rows = [(r.randint(0, 50), i) for i in range(r.randint(0, 400))]
        runs = [sorted(rows[i::7]) for i in range(7)]
        chunks = sorted(run[i : i + 9] for run in runs for i in range(0, len(run), 9))
        stop = r.randint(0, len(rows) + 3)
        opened = []
        out = list(importance_sample.merge((opened.append(c) or c for c in chunks), stop))
        assert [x for x, ok in out if ok] == sorted(rows)[:stop]
        assert sorted(x for x, _ in out) == sorted(rows), trial


def brute_draw(rows, target, percent, least, ngrams, buckets, seed):
    def bag(t):
        w = words_of(t)
        return Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, ngrams + 1) for i in range(len(w) - n + 1))

    own = [bag(t) for _, t in rows]
    s, t = sum(own, Counter()), sum(map(bag, target), Counter())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    out = []
    for no, ((d, text), f) in enumerate(zip(rows, own, strict=True)):
        weight = sum(gain[b] * n for b, n in f.items())
        out.append([d, f.total(), weight, weight + importance_sample.gumbel(None if d is None else str(d), seed), None, no, len(words_of(text))])
    eligible = sorted((x for x in out if x[6] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0, x[5]))
    for rank, x in enumerate(eligible[: percent * len(eligible) // 100], 1):
        x[4] = rank
    return [tuple(x[:5]) for x in out]


@pytest.mark.parametrize(("percent", "ngrams", "chunk"), [(10, 1, 256), (60, 2, 4), (100, 1, 3)])
def test_draw_equals_brute_force(spark, monkeypatch, percent, ngrams, chunk):
    monkeypatch.setattr(importance_sample, "CHUNK", chunk)
    texts = texts_of()
    rows = [(None if i % 40 == 3 else i // 2 if i > 290 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(d, t, "en", "s", 1, 1, "w", "x", 2) for d, t in rows], EXTRA).coalesce(1)
    target = [drawn(500 + i, 30, 9) for i in range(4)] + [None]
    got = importance_sample.draw(df, spark.createDataFrame([(t,) for t in target], "text string"), percent, 20, ngrams, 500, 7).collect()
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(brute_draw(rows, target, percent, 20, ngrams, 500, 7), key=key)


def test_draw_of_empty_sides(spark):
    none, some = docs(spark, ["a"]).limit(0), docs(spark, ["b " * 30] * 20)
    assert importance_sample.draw(none, some).count() == 0
    assert sorted(r["rank"] for r in importance_sample.draw(some, none).collect() if r["rank"]) == [1, 2]


def test_quality_counts_equal_brute_force(spark):
    texts = [*ODD, "a b c a b c", "a a a a a", "a b\tc d\x0ba b c #x", "x y\nx y\n\n \nx  y\n", "É!! É!! #*$%&|<> é", "\xa0a b c", prose(3, 400) + " " + prose(3, 400), "one two three " * 20000, drawn(1, 500)]
    for r in quality_rules.measured(docs(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + d for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if x.strip("\x20\t\n\x0b\x0c\r")]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(lines), sum(c.isupper() for c in t), t.count("!"))
        assert want == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines, r.n_capitals, r.n_exclamations), t[:40]


def test_most_rejected_is_the_exact_bound(spark):
    cases = [(n, risk, level) for n in (1, 5, 60, 458, 459, 5000, 40000) for risk, level in ((0.01, 0.01), (0.005, 0.002), (0.2, 0.05))]
    for n, risk, level in cases:
        got = spark.range(1).select(quality_rules.most_rejected(F.lit(n).cast("long"), risk, F.lit(level))).first()[0]
        want, total = -1, 0.0
        for k in range(n + 1):
            total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(risk) + (n - k) * math.log(1 - risk))
            if total > level:
                break
            want = k
        assert got == want, (n, risk, level)


def test_quality_cutoffs_limit_false_rejection(spark):
    """Half of the good rows carry labels; the cutoffs reject no more than the risk of all of them, and most bad ones, in the stratum that has labels."""
    r = random.Random(5)
    rows, labels = [], []
    for i in range(6000):
        bad, lang = i % 5 == 0, "a" if i % 3 else None
        share = r.uniform(0.1, 0.9) if bad else max(0.0, r.gauss(0, 0.02))
        words = [("%w" if r.random() < share else "w") + str(r.randint(0, 10**6)) for _ in range(60)]
        rows.append((i, " ".join(words), lang))
        if lang and i % 2:
            labels.append((i, int(not bad)))
    labels += [(0, 1), (0, 0), (None, 1), (7, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = quality_rules.judged(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(out) == 6000 and not any(x.base_failed for x in out)
    assert all(x.kept for x in out if x.stratum is None)
    good = [x.kept for x in out if x.stratum and x.doc_id % 5]
    bad = [x.kept for x in out if x.stratum and not x.doc_id % 5]
    assert good.count(False) <= 0.03 * len(good) and bad.count(False) > 0.95 * len(bad)
    assert {x.rejected_by for x in out} == {"", "symbols"}


def test_quality_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.judged(docs(spark, ["a"]).limit(0), none).count() == 0
    texts = ["a", None, " ".join(f"w{i}" for i in range(60))]
    out = sorted((x.doc_id, x.base_failed, x.kept) for x in quality_rules.judged(docs(spark, texts), none).collect())
    assert out == [(0, True, False), (1, True, False), (2, False, True)]


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_importance_sample", "op13_quality_rules"])
def test_queries_equal_their_sql(spark, name):
    assert differences(llm.QUERIES[name](spark, SMALL), SMALL, llm.ORACLES[name]) == []
