"""Classes against brute force: groups of near copies, moved halves, large buckets, rows that share a doc_id."""

import random

import numpy as np
import pytest

from tidebar.llm import order_minhash as om

DOCS = "doc_id long, text string"


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]


def edited(base, seed, share):
    r = random.Random(seed)
    return [w if r.random() > share else f"new{r.randint(0, 10**6)}" for w in base]


def brute(texts):
    ids = [om.word_ids(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and (ids[i].tolist() == ids[j].tolist() or om.linked(ids[j], ids[i])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(k) for k in range(len(texts))]


def corpus(n):
    texts = []
    for g in range(8):
        base = words(g, 60 + 40 * g)
        texts += [" ".join(edited(base, 1000 * g + k, share)) for k, share in enumerate(np.linspace(0, 0.06, n))]
        half = len(base) // 2
        texts += [" ".join(base[half:] + base[:half]), " ".join(base).upper(), " ".join(base[: int(len(base) * 0.82)])]
    return texts + ["one two", "two one", "one two", "", None, " ".join(words(99, 3000))]


@pytest.mark.parametrize("block", [om.BLOCK, 8])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(om, "BLOCK", block)
    texts = corpus(14)
    got = {r.doc_id: r.class_id for r in om.near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)


def test_no_close_pair_is_ruled_out_and_forests_connect():
    texts = [t for t in corpus(20) if t]
    sets = [np.unique(om.shingles(om.word_ids(t))) for t in texts]
    signs = [om.signature(x) for x in sets]
    x, y = om.close_pairs(np.array([s for s, _ in signs]), np.array([b for _, b in signs], dtype=object))
    passing = set(zip(x.tolist(), y.tolist(), strict=True))
    close = {(i, j) for j in range(len(sets)) for i in range(j) if om.similarity(sets[i], sets[j]) >= om.SIMILARITY}
    assert close <= passing and len(passing) < 1.3 * len(close)

    def reach(pairs):
        root = list(range(len(sets)))
        for _ in range(len(sets)):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    a, b = om.forest(len(sets), x, y)
    assert reach(list(zip(a, b, strict=True))) == reach(sorted(passing)) and len(a) < len(sets)


def test_alignment_of_long_texts():
    base = np.array(om.word_ids(" ".join(words(5, 4000))))
    swapped = np.concatenate([base[2000:], base[:2000]])
    assert not om.aligned(base, swapped)
    r = np.random.default_rng(1)
    few = base.copy()
    few[r.choice(4000, 700, replace=False)] += np.uint64(1)
    many = base.copy()
    many[r.choice(4000, 1300, replace=False)] += np.uint64(1)
    assert om.aligned(base, few) and not om.aligned(base, many)
    moved = np.concatenate([base[:1000], base[1300:2500], base[1000:1300], base[2500:]])
    assert om.aligned(base, moved) and om.aligned(moved, base)


def test_all_diagonals_equal_edit_distance():
    r = random.Random(4)
    for _ in range(150):
        a, b = ([r.randint(0, 3) for _ in range(r.randint(1, 14))] for _ in range(2))
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        x, y = np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)
        for band in range(14):
            assert om.within_band(x, y, band, plain=r.choice([0, 1, 3])) == (d[-1] <= band)


def test_rows_that_share_a_doc_id(spark):
    import corpus_pipeline

    a, b, c = (" ".join(words(k, 60)) for k in (1, 2, 3))
    near = a + " tail"
    rows = [(1, a), (2, near), (2, b), (3, c), (3, c), (None, a), (None, None), (2**53 + 1, c), (2**53 + 2, c + " end")]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(((r.doc_id, r.class_id) for r in om.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (2, 2), (3, 3), (3, 3), (None, None), (None, None), (2**53 + 1, 3), (2**53 + 2, 3)], key=str)
    left = sorted((tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, None).collect()), key=str)
    assert left == sorted([(1, a), (2, b), (3, c), (None, a), (None, None)], key=str)
    # two texts of one class and one doc_id: one stays
    both = spark.createDataFrame([(7, a), (7, near)], DOCS)
    assert corpus_pipeline.drop_near_copies(spark, both, None).count() == 1


def test_contaminated_rows_go_by_their_own_text(spark):
    from tidebar.llm import decontaminate

    item, clean = " ".join(words(8, 20)), " ".join(words(9, 40))
    docs = spark.createDataFrame([(1, item), (1, clean), (None, item), (None, clean), (2, None)], DOCS)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted((tuple(r) for r in decontaminate.keep_clean(docs, bench).collect()), key=str) == sorted([(1, clean), (None, clean), (2, None)], key=str)


def test_near_dedup_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert om.near_duplicates(none).count() == 0 and om.keep_first(none).count() == 0
