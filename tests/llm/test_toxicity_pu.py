"""The unlabelled sample comes from all documents, the prior from all labels, and the correction can bind."""

import numpy as np
from pyspark.sql import functions as F

from tidebar.llm import toxicity


def test_sample_and_prior(spark):
    d = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("word w"), F.col("id")).alias("text"))
    labels = d.where("doc_id < 100").select("doc_id", (F.col("doc_id") < 20).cast("int").alias("toxic"))
    learnt = labels.where(~toxicity.held_out())
    rows = toxicity.learning_rows(d, labels, 5, 10_000)
    assert sum(r.toxic for r in rows) == 5
    # rows without a label are drawn, held-out rows are not
    assert sum(r.toxic == 0 for r in rows) == d.where(~toxicity.held_out()).count() > learnt.count()
    # the prior does not follow the sample's own share
    assert toxicity.class_prior(d, labels) == learnt.where("toxic = 1").count() / learnt.count()
    alone = labels.where("toxic = 1")
    assert toxicity.class_prior(d, alone) == learnt.where("toxic = 1").count() / d.where(~toxicity.held_out()).count()


def test_the_corrected_risk_goes_below_zero():
    y = np.array([True] * 5 + [False] * 20)
    assert toxicity.corrected(np.where(y, 8.0, -8.0), y, 0.2) < 0
    assert toxicity.corrected(np.zeros(25), y, 0.2) > 0


def test_unconfirmed_positives_are_found():
    rng = np.random.default_rng(3)

    def words(toxic):
        return np.array(sorted({*rng.choice(50, 12), *(100 + rng.choice(6, 3) if toxic else [])}), dtype=np.uint32).tobytes()

    # a fifth of the drawn rows is toxic and not marked, as many as are confirmed
    rows = [(1, words(True)) for _ in range(60)] + [(0, words(True)) for _ in range(60)] + [(0, words(False)) for _ in range(240)]
    weights, bias = toxicity.fit(sorted(rows), 0.2)
    score = lambda w: bias + sum(weights.get(int(x), 0.0) for x in np.frombuffer(w, np.uint32))
    assert sum(score(w) > 0 for _, w in rows[60:120]) >= 54
    assert sum(score(w) > 0 for _, w in rows[120:]) <= 12


def test_gradient_of_the_non_negative_risk():
    rng = np.random.default_rng(5)
    y = np.array([True] * 7 + [False] * 30)

    def risk(z):
        return 0.3 * np.logaddexp(0, -z[y]).mean() + max(0.0, toxicity.corrected(z, y, 0.3))

    bound = 0
    for _ in range(20):
        # where positives score high, the correction binds
        z = rng.normal(size=37) + np.where(y, rng.uniform(0, 8), rng.uniform(-4, 0))
        bound += toxicity.corrected(z, y, 0.3) < 0
        want = [(risk(z + e) - risk(z - e)) / 2e-5 for e in np.eye(37) * 1e-5]
        assert np.allclose(toxicity.gradient(z, y, 0.3), want, atol=1e-6)
    assert 0 < bound < 20


def test_a_doc_id_with_many_texts_is_learnt_from_once(spark):
    d = spark.range(200).select((F.col("id") % 20).alias("doc_id"), F.concat(F.lit("word w"), F.col("id")).alias("text"))
    labels = spark.range(20).select(F.col("id").alias("doc_id"), (F.col("id") < 10).cast("int").alias("toxic"))
    assert len(toxicity.learning_rows(d, labels, 5, 10)) <= 15


def test_held_out_recall(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxicity(d, labels).where("held_out").join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert np.mean([a.score > b.score for a in toxic for b in clean]) >= 0.95
