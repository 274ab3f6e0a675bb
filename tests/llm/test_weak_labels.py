import os

import numpy as np
import pytest

from mldiag.llm import weak_labels as weak

FOLDER = "/root/testdata/sf0.1"


def test_accuracies_are_recovered():
    rng = np.random.default_rng(0)
    truth = rng.random(200_000) < 0.7
    accuracy = np.array([0.95, 0.9, 0.8, 0.7, 0.6, 0.85])
    right = rng.random((len(truth), 6)) < accuracy
    votes = np.where(rng.random(right.shape) < 0.3, weak.NONE, np.where(right, truth[:, None], ~truth[:, None]))
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = weak.expectation_maximisation(patterns, counts)
    assert abs(model.prior - 0.7) < 0.01 and np.abs(model.accuracy - accuracy).max() < 0.02
    share = model.posterior(patterns)[inverse.ravel()]
    assert ((share > 0.5) == truth).mean() > 0.93


def test_counts_of_patterns_weigh_like_rows():
    rng = np.random.default_rng(1)
    patterns = rng.integers(0, 3, (50, 4))
    counts = rng.integers(1, 9, 50)
    a = weak.expectation_maximisation(patterns, counts)
    b = weak.expectation_maximisation(np.repeat(patterns, counts, axis=0), np.ones(int(counts.sum())))
    assert np.allclose(a.accuracy, b.accuracy) and np.isclose(a.prior, b.prior)


def test_odd_rows(spark):
    texts = [None, "", " \n", "a", "x" * 200_000, "TABLE | OF | X!! " * 40, "the cat and the dog were here. " * 9, "word " * 300_000]
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t in enumerate(texts * 3)] + [(None, "x", "s", 0.1)], "doc_id bigint, text string, votes string, score double")
    got = weak.classify(docs).collect()
    assert len(got) == len(texts) * 3 + 1
    by_text = {}
    for r in got:
        assert 0 <= r.score <= 1 and 0 <= r.posterior <= 1 and r.kept == (r.score >= 0.5) == bool(r.quality)
        if r.doc_id is not None:
            by_text.setdefault(texts[r.doc_id % len(texts)] or "", set()).add((r.score, r.posterior, r.n_votes))
    assert all(len(s) == 1 for s in by_text.values())
    assert weak.classify(docs.filter("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_agrees_with_true_labels(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(8)
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = [r for r in weak.classify(docs).collect() if r.doc_id in truth]
    scores, labels = np.array([r.score for r in rows]), np.array([truth[r.doc_id] for r in rows])
    order = np.argsort(scores)
    rank = np.empty(len(rows))
    rank[order] = np.arange(1, len(rows) + 1)
    good = labels == 1
    area = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    kept = np.array([r.kept for r in rows])
    print("area", area, "good kept", kept[good].mean(), "bad kept", kept[~good].mean())
    assert area > 0.95 and kept[good].mean() > 0.97 and kept[~good].mean() < 0.2
