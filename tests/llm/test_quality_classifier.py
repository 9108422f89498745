"""Co-training: accuracy on rows without a label, what a second view adds, odd tables."""

import numpy as np
from data import DOCS, awkward, empty

from pairlace.llm import quality_classifier as qc


def corpus(rng, n):
    good, bad = ["theory", "history", "analysis", "river", "garden", "letter"], ["buy", "cheap", "click", "casino", "winner", "deal"]
    rows, y = [], []
    for k in range(n):
        is_good = bool(rng.random() < 0.6)
        words = [str(rng.choice(good if (rng.random() < 0.8) == is_good else bad)) for _ in range(int(rng.integers(15, 80)))]
        text = " ".join(words) + ("." if is_good else "!!! $$$")
        rows.append((k, text, "en", "book" if (rng.random() < 0.7) == is_good else "forum", len(text)))
        y.append(int(is_good))
    return rows, y


def test_accuracy_on_unlabelled_rows(spark):
    rng = np.random.default_rng(1)
    rows, y = corpus(rng, 1500)
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, y[k], 0) for k in range(200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in qc.score_quality(docs, labels).collect()}
    assert len(got) == 1500
    hit = [(got[k].score >= 0.5) == y[k] for k in range(200, 1500)]
    assert np.mean(hit) > 0.95
    assert all(0 <= r.p_content <= 1 and 0 <= r.p_metadata <= 1 and 0 <= r.score <= 1 for r in got.values())
    again = {r.doc_id: r.score for r in qc.score_quality(docs.repartition(5), labels).collect()}
    assert all(abs(again[k] - r.score) < 1e-4 for k, r in got.items())


def test_views_label_each_other():
    """Two views that are each informative: the weaker one gains from the other's pseudo-labels."""
    rng = np.random.default_rng(2)
    y = (rng.random(2040) < 0.5).astype(float)
    a = (y[:, None] * 2 - 1) * 1.2 + rng.normal(size=(2040, 3))
    b = (y[:, None] * 2 - 1) * 0.35 + rng.normal(size=(2040, 30))
    fit, pool = slice(0, 40), slice(40, 2040)
    right = lambda model: np.mean((qc.apply(model[0][1], b[pool]) > 0) == y[pool])
    alone = qc.co_train([a[fit], b[fit]], y[fit], [a[pool], b[pool]], rounds=0)
    taught = qc.co_train([a[fit], b[fit]], y[fit], [a[pool], b[pool]], rounds=4)
    assert right(taught) > right(alone) + 0.02


def test_odd_labels(spark):
    docs, n = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score > 0.99 for r in qc.score_quality(docs, none).collect()} == {True}
    some = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (4, 0), (5, 1), (6, 0), (None, 1), (7, None)], "doc_id long, quality int")
    assert qc.score_quality(docs, some).count() == n
    kept = qc.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == n
    assert qc.score_quality(empty(spark), some).count() == 0 and qc.keep_good(empty(spark), some).count() == 0
