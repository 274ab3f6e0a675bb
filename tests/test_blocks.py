"""Blocks that meet all others, and the joins made of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mldiag.operators import blocks, neighbors


def _rows(spark, v, parts=3):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>").repartition(parts)


def test_rows_are_packed_once_in_blocks_of_one_key(spark):
    df = spark.range(100).select("id", F.array(F.col("id").cast("double")).alias("v"), (F.col("id") % 3).cast("int").alias("c"))
    found = blocks.packed(df, lambda f: f["id"].tolist(), 100, 8, [F.col("c"), F.col("id") % 5], "c").collect()
    import pickle

    held = [(r["key"], pickle.loads(r["payload"])) for r in found]
    assert sorted(i for _, ids in held for i in ids) == list(range(100))
    assert all(len(ids) <= 8 and all(i % 3 == key for i in ids) for key, ids in held)
    assert len({r["number"] for r in found}) == len(found)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_neighbour_join_makes_no_copies_for_pairs_of_blocks(spark, metric):
    """rows used to be written once for each block of the other side that they might meet."""
    rng = np.random.RandomState(5)
    v = rng.randn(300, 8)
    df = _rows(spark, v)
    found = neighbors.knn_join(df, df, "id", "v", 3, metric, exclude_self=True, n_cells=6, block_rows=20)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "CoGroups" not in plan
    u = v / np.linalg.norm(v, axis=1)[:, None] if metric == "cosine" else v
    d = np.sqrt(((u[:, None] - u[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = found.orderBy("id", "rank").collect()
    assert [r["neighbor"] for r in got] == np.argsort(d, axis=1, kind="stable")[:, :3].ravel().tolist()
    best = np.sort(d, axis=1)[:, :3].ravel()
    assert np.allclose([r["distance"] for r in got], best * best / 2 if metric == "cosine" else best)


def test_vectors_far_from_the_origin(spark):
    """Differences below what single precision can hold decide."""
    rng = np.random.RandomState(6)
    v = 1e4 + rng.randn(120, 3) * 1e-3
    df = _rows(spark, v)
    got = neighbors.knn_join(df, df, "id", "v", 2, exclude_self=True, n_cells=4, block_rows=30).orderBy("id", "rank").collect()
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert [r["neighbor"] for r in got] == np.argsort(d, axis=1, kind="stable")[:, :2].ravel().tolist()


@pytest.mark.parametrize("copies", [0, 90])
def test_quality_makes_no_copies_for_pairs_of_blocks(spark, copies):
    """F2, F6, F7, F8: ranks, limits and stress of many blocks, also where a third of all rows are copies."""
    from mldiag.operators import quality

    rng = np.random.RandomState(8)
    v = rng.randn(270, 5)
    if copies:
        v[100 : 100 + copies] = v[100]
    df = _rows(spark, v).withColumns({"x": F.col("v")[0], "y": F.col("v")[1]})
    points = quality._points(df, "id", "v", {"m": ("x", "y")})
    sums = quality.stress_sums(points, {"m": ("x", "y")}, 32)
    counts = quality.neighborhood_counts(df, "id", "v", {"m": ("x", "y")}, [7], block_rows=32)
    for found in (sums, counts):
        assert "CoGroups" not in found._jdf.queryExecution().analyzed().toString()
    d, e = (np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) for x in (v, v[:, :2]))
    row = sums.first()
    assert row["d2"] == pytest.approx((d**2).sum()) and row["e2"] == pytest.approx(((d - e) ** 2).sum())
    np.fill_diagonal(d, np.inf)
    np.fill_diagonal(e, np.inf)
    rank = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1, kind="stable") + 1
    near = np.argsort(e, axis=1, kind="stable")[:, :7]
    far = np.take_along_axis(rank, near, 1) - 7
    got = counts.orderBy("id").collect()
    assert [r["penalty"] for r in got] == np.maximum(far, 0).sum(1).tolist()
    assert [r["missing"] for r in got] == (far > 0).sum(1).tolist()


@pytest.mark.parametrize("text", [False, True])
def test_votes_make_no_copies_for_pairs_of_blocks(spark, text):
    """F11 (numbers as ids), F12 (text ids, as train_knn has them): the votes of many blocks are those of the nearest rows."""
    rng = np.random.RandomState(9)
    v, label = rng.randn(160, 4), rng.randint(0, 3, 160)
    rows = [(f"v{i:04d}" if text else i, x.tolist(), "abc"[c]) for i, (x, c) in enumerate(zip(v, label))]
    df = spark.createDataFrame(rows, f"id {'string' if text else 'bigint'}, v array<double>, label string").repartition(3)
    found = neighbors.knn_classify(df, df, "id", "v", "label", ["a", "b", "c"], 5, n_cells=5, block_rows=16)
    assert "CoGroups" not in found._jdf.queryExecution().analyzed().toString()
    near = label[np.argsort(((v[:, None] - v[None]) ** 2).sum(2), axis=1, kind="stable")[:, :5]]
    want = np.stack([(near == c).mean(1) for c in range(3)], axis=1)
    got = found.orderBy("id").collect()
    assert np.allclose([r["probability"] for r in got], want)
    assert [r["prediction"] for r in got] == ["abc"[c] for c in want.argmax(1)]
