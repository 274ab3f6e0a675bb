import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import mldiag
from mldiag.operators import embed, neighbors, quality, reduce, transforms


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.RandomState(11)
    v = np.concatenate([rng.normal(c, 0.3, (60, 6)) for c in (0, 2, 5)])
    v[100:160] = v[100]  # a third of all rows are copies
    pdf = pd.DataFrame({"id": np.arange(len(v)), "v": v.tolist(), "label": ["a", "b", "c"] * 60})
    return v, spark.createDataFrame(pdf).repartition(5).cache()


def brute(v, k, skip_self):
    out = {}
    for i in range(len(v)):
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(len(v)), d)) if not (skip_self and j == i)]
        out[i] = order[:k]
    return out


@pytest.mark.parametrize("cells, block, skip", [(1, 4096, True), (8, 16, True), (8, 16, False), (60, 20, True)])
def test_neighbour_join_is_exact(points, cells, block, skip):
    v, df = points
    got = neighbors.knn_join(df, df, "id", "v", 4, exclude_self=skip, n_cells=cells, block_rows=block).toPandas()
    want = brute(v, 4, skip)
    assert len(got) == 4 * len(v)
    for i, g in got.sort_values("rank").groupby("id"):
        assert g["neighbor"].tolist() == want[i]


def test_more_neighbours_than_points(points):
    v, df = points
    few = df.where("id in (1, 2, 70)")
    assert neighbors.knn_join(few, few, "id", "v", 9, exclude_self=True, n_cells=2).count() == 6


def test_votes(points):
    _, df = points
    got = neighbors.knn_classify(df, df, "id", "v", "label", ["a", "b", "c"], 5).toPandas()
    assert len(got) == 180 and all(abs(sum(p) - 1) < 1e-9 for p in got["probability"])


def test_similar_rows_leave_out_only_the_query(points):
    v, df = points
    got = neighbors.similar_rows(df, "id", "v", 120, 3, "euclidean").toPandas()
    assert got["id"].tolist() == [100, 101, 102] and (got["distance"] == 0).all()
    plan = neighbors.similar_rows(df, "id", "v", 1, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


def test_tfidf_by_hand(spark):
    texts = ["Red red fox", "red dog", "the fox!", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = embed.tfidf(df, "id", "text", stop_words=["the"]).toPandas()
    idf = {t: np.log(5 / (1 + n)) + 1 for t, n in (("red", 2), ("fox", 2), ("dog", 1), ("nan", 1))}
    first = np.array([2 * idf["red"], idf["fox"]])
    first /= np.linalg.norm(first)
    row = got[got["id"] == 0].set_index("term")["weight"]
    assert row["red"] == pytest.approx(first[0]) and row["fox"] == pytest.approx(first[1])
    assert got[got["id"] == 3]["term"].tolist() == ["nan"]
    vectors = embed.tfidf_vectors(df, "id", "text", stop_words=["the"])
    lengths = vectors.select(vector_to_array("embedding").alias("e")).collect()
    assert all(np.linalg.norm(r["e"]) == pytest.approx(1) for r in lengths)
    top = embed.vocabulary(df, "id", "text", 2, ["the"]).toPandas()
    assert top["term"].tolist() == ["red", "fox"]
    assert "the" in embed.english_stop_words()


def test_embedding_dispatch(spark):
    df = spark.createDataFrame([(1, 2.0, "x"), (2, float("nan"), "y")], "id int, f double, s string")
    assert embed.embed(df).first()["embedding"] == [1.0, 2.0]
    with pytest.raises(ValueError):
        embed.embed(df, "nope")
    encoder = lambda values: np.array([[len(v), 1.0] for v in values])
    coded = embed.embed(df, "text", text_col="s", encoder=encoder).collect()
    assert [r["embedding"] for r in coded] == [[1.0, 1.0]] * 2
    with pytest.raises(ValueError):
        transforms.feature_embedding(df.select("s"))


def test_pca_matches_numpy(points):
    v, df = points
    got = reduce.reduce2d(df, "pca", "v").toPandas().sort_values("id")
    centred = v - v.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    for i, name in enumerate("xy"):
        assert abs(np.corrcoef(centred @ axes[i], got[name])[0, 1]) == pytest.approx(1)
        assert got[name].mean() == pytest.approx(0, abs=1e-9)
        assert got[name].std(ddof=0) == pytest.approx((centred @ axes[i]).std())


def test_landmarks_keep_distances_of_flat_data(spark):
    rng = np.random.RandomState(2)
    flat = rng.rand(80, 2) @ rng.rand(2, 7)
    df = spark.createDataFrame(pd.DataFrame({"id": range(80), "v": flat.tolist()}))
    got = reduce.landmark_mds(df, "id", "v", landmarks=20).toPandas().sort_values("id")[["x", "y"]].to_numpy()
    pair = lambda m: np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
    assert np.allclose(pair(got), pair(flat), atol=1e-6)


def test_low_dimension_passes_through(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id int, embedding array<double>")
    row = reduce.reduce2d(df).first()
    assert (row["x"], row["y"]) == (1.0, 2.0)
    with pytest.raises(ValueError):
        reduce.reduce2d(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id int, embedding array<double>"), "nope")


def test_quality_matches_numpy(points):
    v, df = points
    placed = df.withColumns({"x": F.col("v")[0], "y": F.col("v")[1]})
    n, k = len(v), 10
    d, e = (np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1)) for m in (v, v[:, :2]))
    penalty = 0
    for i in range(n):
        order = [j for j in np.argsort(d[i], kind="stable") if j != i]
        rank = {j: r for r, j in enumerate(order, 1)}
        near = [j for j in np.argsort(e[i], kind="stable") if j != i][:k]
        penalty += sum(max(0, rank[j] - k) for j in near)
    row = quality.quality_metrics(placed, "id", "v").first()
    assert row["trustworthiness"] == pytest.approx(1 - 2 * penalty / (n * k * (2 * n - 3 * k - 1)), abs=1e-6)
    assert row["stress"] == pytest.approx(np.sqrt(((d - e) ** 2).sum() / (d**2).sum()), abs=1e-6)


def test_perfect_projection(spark):
    rng = np.random.RandomState(4)
    df = spark.createDataFrame(pd.DataFrame({"id": range(60), "v": rng.rand(60, 2).tolist()}))
    placed, metrics = quality.reduce_with_quality(df, "id", "v")
    curves = quality.quality_curves(placed, "id", "v", {"m": ("x", "y")}).toPandas()
    assert (curves["trustworthiness"] == 1).all() and (curves["continuity"] == 1).all()
    assert curves["k"].max() * 2 < 60 and metrics.first()["stress"] == 0
    assert quality.sampled_stress(placed, "id", "v", {"m": ("x", "y")}).first()["level"] == "green"


def test_clusters_and_explore(points):
    _, df = points
    found = mldiag.explore(df.drop("label"), "id", embedding="v", n_clusters=3)
    sizes = found.frame.groupBy("cluster").count().toPandas()["count"]
    assert sizes.sum() == 180 and len(sizes) == 3
    one = df.limit(1).withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    assert "cluster" not in neighbors.auto_cluster(one, "id").columns


def test_neighbour_join_takes_text_ids(points):
    v, df = points
    named = df.select(F.format_string("point-%05d", F.col("id")).alias("id"), "v")
    got = neighbors.knn_join(named, named, "id", "v", 4, exclude_self=True, n_cells=8, block_rows=16).toPandas()
    want = brute(v, 4, True)
    for i, g in got.sort_values("rank").groupby("id"):
        assert g["neighbor"].tolist() == [f"point-{j:05d}" for j in want[int(i[6:])]]


def test_sparse_vectors_are_reduced(spark):
    rng = np.random.RandomState(4)
    words = [f"w{i:03d}" for i in range(150)]
    texts = [" ".join(rng.choice(words[: 40 if i % 2 else 150], 30)) for i in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = embed.tfidf_vectors(df, "id", "text", stop_words=[])
    dense = np.array([r["e"] for r in rows.orderBy("id").select(vector_to_array("embedding").alias("e")).collect()])
    placed = reduce.pca(rows, "embedding", passes=40).toPandas().sort_values("id")
    centred = dense - dense.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    for i, name in enumerate("xy"):
        assert abs(np.corrcoef(centred @ axes[i], placed[name])[0, 1]) == pytest.approx(1, abs=1e-4)
    far = reduce.landmark_mds(rows, "id", "embedding", 2, landmarks=90).toPandas().sort_values("id")
    for i, name in enumerate("xy"):  # with all rows as landmarks the scaling gives the principal axes
        assert abs(np.corrcoef(centred @ axes[i], far[name])[0, 1]) == pytest.approx(1, abs=1e-4)


def test_quality_covers_all_rows_by_brute_force(points):
    v, df = points
    plane = df.select("id", "v", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    got = quality.quality_metrics(plane, "id", "v", k=7).first()
    n, k = len(v), 7
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    e = np.sqrt(((v[:, None, :2] - v[None, :, :2]) ** 2).sum(-1))
    penalty = 0
    for i in range(n):
        others = [j for j in range(n) if j != i]
        rank = {j: r for r, j in enumerate(sorted(others, key=lambda j: (d[i, j], j)), 1)}
        penalty += sum(max(0, rank[j] - k) for j in sorted(others, key=lambda j: (e[i, j], j))[:k])
    assert got["trustworthiness"] == pytest.approx(1 - 2 / (n * k * (2 * n - 3 * k - 1)) * penalty, abs=1e-6)
    assert got["stress"] == pytest.approx(np.sqrt(((d - e) ** 2).sum() / (d**2).sum()), abs=1e-6) and got["n_samples"] == n


def _plain_counts(v, planes, ids, ks):
    """(method, k) -> (penalty, missing) over all rows, ties by id."""
    n, out = len(v), {}
    order = lambda m, i: sorted((j for j in range(n) if j != i), key=lambda j: (round(float(np.sqrt(((m[i] - m[j]) ** 2).sum())), 12), ids[j]))
    for name, plane in planes.items():
        for i in range(n):
            rank = {j: r for r, j in enumerate(order(v, i), 1)}
            near = order(plane, i)
            for k in ks:
                beyond = [rank[j] - k for j in near[:k] if rank[j] > k]
                p, m = out.get((name, k), (0, 0))
                out[name, k] = (p + sum(beyond), m + len(beyond))
    return out


@pytest.mark.parametrize("block", [1000, 12])
def test_range_counting_by_brute_force(spark, block):
    """Ranks counted by rings and cells equal those of sorted distances, with copies and odd ids among the rows."""
    rng = np.random.RandomState(6)
    v = np.concatenate([rng.randn(30, 5) + 20 * c for c in range(3)] + [rng.randn(1, 5).repeat(4, 0)])
    ids = [-7 + 3 * i for i in range(len(v))]
    rows = [(i, x.tolist(), float(x[0]), float(x[1]), float(x[2]), float(x[3])) for i, x in zip(ids, v)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, a double, b double, c double, d double").repartition(3)
    got = quality.neighborhood_counts(df, "id", "v", {"one": ("a", "b"), "two": ("c", "d")}, [3, 8], block_rows=block)
    sums = got.groupBy("method", "k").agg(F.sum("penalty").alias("p"), F.sum("missing").alias("m"), F.count("*").alias("n")).collect()
    wanted = _plain_counts(v, {"one": v[:, :2], "two": v[:, 2:4]}, ids, [3, 8])
    assert {(r["method"], r["k"]): (r["p"], r["m"]) for r in sums} == wanted and all(r["n"] == len(v) for r in sums)
    text = df.withColumn("id", F.format_string("k%05d", F.col("id") + 100))
    named = quality.neighborhood_counts(text, "id", "v", {"one": ("a", "b")}, [3], block_rows=block)
    assert named.agg(F.sum("penalty"), F.sum("missing")).first()[:] == wanted["one", 3]


def test_rows_of_clusters_reach_few_cells(spark):
    """On clustered vectors a row is sent to little more than its own cell."""
    rng = np.random.RandomState(2)
    v = np.concatenate([rng.randn(50, 4) * 0.1 + 50 * rng.randn(4) for _ in range(12)])
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    limits = [0.1, 0.2]
    asking = points.select("id", "v", F.array(*map(F.lit, limits)).alias("limits"), F.array(F.lit(0), F.lit(1)).cast("array<bigint>").alias("ids"))
    asked, _ = quality.reached_cells(points, asking, len(v), "bigint", 20)
    sent = asked.agg(F.sum(F.size("cells"))).first()[0]
    assert sent < 4 * len(v)  # of 30 cells
