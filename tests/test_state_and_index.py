import numpy as np
import pytest
from pyspark.sql import functions as F

from mldiag.operators import neighbors, reduce, sketches, vector_index
from mldiag.session import shared_folder


def test_merged_quantiles_stay_near_the_ranks(spark):
    rng = np.random.RandomState(1)
    values = np.concatenate([rng.randn(30_000), np.full(15_000, 0.25)])  # a third of all rows share a value
    df = spark.createDataFrame([(i % 40, float(v)) for i, v in enumerate(values)], "day int, v double")
    state = sketches.quantile_state(df, ["v"], F.col("day"), 256)
    assert state.count() == 40 and state.agg(F.sum("n")).first()[0] == len(values)
    probabilities = [0.01, 0.1, 0.5, 0.9, 0.99]
    row = sketches.quantiles_of(sketches.merged_quantiles(state, k=256), probabilities).first()
    once = sketches.quantiles_of(sketches.merged_quantiles(sketches.quantile_state(df, ["v"], F.lit(0), 256), k=256), probabilities).first()
    for found in (row, once):
        assert found["n"] == len(values)
        for p, q in zip(probabilities, found["quantiles"]):
            assert (values < q).mean() - 0.02 <= p <= (values <= q).mean() + 0.02
    bounds = sketches.outlier_bounds(sketches.merged_quantiles(state, k=256)).first()
    assert bounds["lower"] < bounds["q1"] <= bounds["median"] <= bounds["q3"] < bounds["upper"]


def test_states_of_odd_tables(spark):
    df = spark.createDataFrame([(None, 1.0, "a"), (1, None, "a"), (1, 2.0, None), (2, None, None)], "day int, v double, s string")
    state = {r["period"]: r["n"] for r in sketches.quantile_state(df, ["v"], F.col("day")).collect()}
    assert state == {None: 1, 1: 1}
    distinct = sketches.distinct_state(df, ["s", "v"], F.col("day"))
    assert {r["feature"]: r["n_distinct"] for r in sketches.distinct_counts(distinct).collect()} == {"s": 1, "v": 2}
    empty = df.where("false")
    assert sketches.merged_quantiles(sketches.quantile_state(empty, ["v"], F.col("day"))).count() == 0
    change = sketches.distinct_change(distinct, sketches.distinct_state(empty, ["s"], F.col("day"))).orderBy("feature").collect()
    assert [tuple(r)[1:] for r in change] == [(1, 0, 0, 0, 1), (2, 0, 0, 0, 2)]


def test_distinct_change_is_near(spark):
    days = spark.range(90_000).select((F.col("id") % 9).cast("int").alias("day"), (F.col("id") % 60_000 + F.when(F.col("id") >= 60_000, 40_000).otherwise(0)).alias("user"))
    state = sketches.distinct_state(days.where("true"), ["user"], F.when(F.col("user") < 50_000, "old").otherwise("new"), 12)
    counts = {r["period"]: r["n_distinct"] for r in sketches.distinct_counts(state, ["period"]).collect()}
    assert counts["old"] == pytest.approx(50_000, rel=0.05)


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.RandomState(5)
    v = np.concatenate([rng.randn(200, 12) * 0.4 + rng.randn(12) * 2 for _ in range(8)])
    v[300:420] = v[300]  # copies
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None)]
    return v, spark.createDataFrame(rows, "id bigint, v array<double>").repartition(4).cache()


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_index_recall_and_exact_distances(spark, clusters, metric):
    v, df = clusters
    path = shared_folder(spark, "index")
    vector_index.build(df, "id", "v", path, metric)
    assert spark.read.parquet(f"{path}/rows").count() == len(v)
    asked = df.where("id % 50 = 0")
    found = vector_index.search(spark, path, asked, "id", "v", 10, probes=12, metric=metric)
    exact = neighbors.knn_join(asked, df, "id", "v", 10, metric)
    share = vector_index.recall(found, exact).first()
    assert share["queries"] == 32 and share["answers"] == 320 and share["recall"] >= 0.85  # copies tie
    same = found.join(exact.select("id", "neighbor", F.col("distance").alias("d")), ["id", "neighbor"])
    assert same.where(F.abs(F.col("distance") - F.col("d")) > 1e-9).count() == 0


def test_index_of_everything_is_exact(spark, clusters, monkeypatch):
    v, df = clusters
    monkeypatch.setattr(vector_index, "PART_ROWS", 50)
    path = shared_folder(spark, "index")
    vector_index.build(df, "id", "v", path, n_cells=6)
    asked = df.where("id % 97 = 0")
    found = vector_index.search(spark, path, asked, "id", "v", 7, probes=6, candidates=2000, exclude_self=True)
    exact = neighbors.knn_join(asked, df, "id", "v", 7, exclude_self=True)
    key = lambda rows: sorted((r["id"], r["rank"], r["neighbor"], round(r["distance"], 9)) for r in rows.collect())
    assert key(found) == key(exact)


def test_index_of_few_rows(spark):
    few = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, None)], "id bigint, v array<double>")
    for rows, n in ((few, 4), (few.where("false"), 0)):
        path = shared_folder(spark, "index")
        vector_index.build(rows, "id", "v", path)
        assert vector_index.search(spark, path, few, "id", "v", 10).count() == n


def test_rows_without_vectors(spark):
    rows = [(i, [float(i), float(i * i), 1.0], "a" if i < 5 else "b") for i in range(10)] + [(10, None, "a")]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, label string")
    got = neighbors.knn_classify(df.where("v is not null"), df, "id", "v", "label", ["a", "b"], 3)
    assert got.count() == 11 and got.where("id = 10").select("probability", "prediction").first()[:] == (None, None)
    for fn in (lambda x: reduce.pca(x, "v"), lambda x: reduce.landmark_mds(x, "id", "v"), lambda x: reduce.reduce2d(x, "landmark_mds", "v", id_col="id")):
        placed = fn(df)
        assert placed.count() == 11 and placed.where("x is null or y is null").select("id").collect() == [(10,)]
        nothing = fn(df.where("v is null")).collect()
        assert len(nothing) == 1 and nothing[0]["x"] is None
    for fn in (lambda x: reduce.pca(x, "v"), lambda x: reduce.landmark_mds(x, "id", "v")):
        assert fn(df.where("false")).count() == 0
    assert reduce.landmark_mds(df.where("id = 1"), "id", "v").select("x", "y").first()[:] == (0.0, 0.0)
