"""Vocabularies beyond what the driver holds."""

import numpy as np
import pytest

from mldiag.operators import embed, reduce


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.RandomState(3)
    words = np.array(["red", "fox", "dog", "cat", "hen", "owl", "the", "elk", "bee", "ant", "cow", "eel"])
    rows = [(i % 50, " ".join(rng.choice(words, rng.randint(1, 30), p=np.arange(12, 0, -1) / 78)) + f" own{i}") for i in range(90)]
    return spark.createDataFrame([*rows, (None, None), (7, ""), (7, "?!"), *rows[:3]], "id int, text string").repartition(3)


def _sorted(df, *names):
    return sorted((str(r["id"]), str(r["text"]), *[r[n] for n in names]) for r in df.collect())


def test_large_vocabulary_gives_the_same_vectors(texts, monkeypatch):
    """more terms than `DRIVER_TERMS` used to be refused. Repeated and missing ids, empty and missing texts stay."""
    plain = lambda df: sorted((str(r["id"]), str(r["text"]), r["embedding"].size, r["embedding"].indices.tolist(), np.round(r["embedding"].values, 12).tolist()) for r in df.collect())
    want = plain(embed.tfidf_vectors(texts, "id", "text", stop_words=["the"]))
    monkeypatch.setattr(embed, "DRIVER_TERMS", 5)
    monkeypatch.setattr(embed, "BLOCK_TEXTS", 11)
    monkeypatch.setattr(embed, "BLOCK_WORDS", 100)
    assert plain(embed.tfidf_vectors(texts, "id", "text", stop_words=["the"])) == want


def test_landmarks_of_a_large_vocabulary(texts, monkeypatch):
    """landmarks with many dimensions used to be refused as well."""
    rows = embed.tfidf_vectors(texts.where("id is not null").dropDuplicates(["id"]), "id", "text", stop_words=["the"])
    want = np.array([r[2:] for r in _sorted(reduce.landmark_mds(rows, "id", "embedding", landmarks=20), "x", "y")])
    monkeypatch.setattr(embed, "DRIVER_TERMS", 5)
    monkeypatch.setattr(reduce, "MOST_CELLS", 50)
    rows = embed.tfidf_vectors(texts.where("id is not null").dropDuplicates(["id"]), "id", "text", stop_words=["the"])
    got = np.array([r[2:] for r in _sorted(reduce.landmark_mds(rows, "id", "embedding", landmarks=20), "x", "y")])
    assert np.allclose(got, want)


@pytest.mark.parametrize("group", [40, 8_000_000])
def test_principal_axes_of_a_large_vocabulary(texts, monkeypatch, group):
    """more dimensions than the driver holds; the axes are those of a full decomposition, and so are their signs."""
    rows = embed.tfidf_vectors(texts, "id", "text", stop_words=["the"]).cache()
    vectors = np.array([r["embedding"].toArray() for r in rows.orderBy("id", "text").collect()])
    centred = vectors - vectors.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:2] * np.sign(np.take_along_axis(axes[:2], np.abs(axes[:2]).argmax(1)[:, None], 1))
    monkeypatch.setattr(reduce, "DRIVER_DIMENSIONS", 5)
    monkeypatch.setattr(reduce, "GROUP_ENTRIES", group)
    monkeypatch.setattr(reduce, "_centred_products", None)  # it holds dimensions x columns
    got = reduce.pca(rows, "embedding", passes=60).orderBy("id", "text").select("x", "y").collect()
    assert np.allclose(np.array(got), centred @ axes.T, atol=1e-6)
