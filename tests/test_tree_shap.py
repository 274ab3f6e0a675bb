from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from mldiag.operators import scoring, shap, train, tree_shap

FEATURES = [f"f{i}" for i in range(8)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.RandomState(3)
    x = rng.randn(160, 8)
    label = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int) + (x[:, 3] > 0.8)
    data = [(i, *map(float, r), f"c{c}") for i, (r, c) in enumerate(zip(x, label))]
    df = spark.createDataFrame(data, "id int, " + ", ".join(f"{f} double" for f in FEATURES) + ", label string")
    return df.withColumn("f4", F.when(F.col("id") % 9 > 0, F.col("f4"))).repartition(3).cache()


def plain(predict, x, background):
    """Shapley values by all coalitions."""
    m = len(x)
    values = np.zeros(2**m)
    for mask in range(2**m):
        own = np.array([(mask >> i) & 1 == 1 for i in range(m)])
        values[mask] = np.mean([predict(np.where(own, x, z)) for z in background])
    phi = np.zeros(m)
    for i in range(m):
        for mask in range(2**m):
            if not mask >> i & 1:
                s = bin(mask).count("1")
                phi[i] += factorial(s) * factorial(m - s - 1) / factorial(m) * (values[mask | 1 << i] - values[mask])
    return phi


def test_forest_equals_all_coalitions(spark, rows):
    fitted = train.train(rows, "id", FEATURES, "label", "RandomForest", n_trees=7, max_depth=6)
    background = shap.background(rows, "id", FEATURES, 9)
    some = rows.where("id < 12")
    trees = {(r["id"], r["class"], r["feature"]): r["phi"] for r in shap.shap_values(some, "id", fitted.scorer, background).collect()}
    exact = {(r["id"], r["class"], r["feature"]): r["phi"] for r in shap.shap_values(some, "id", fitted.scorer, background, "exact").collect()}
    assert trees.keys() == exact.keys() and len(trees) == 12 * 8 * 3
    assert max(abs(trees[k] - exact[k]) for k in trees) < 1e-9


@pytest.mark.parametrize("cells", [tree_shap.CELLS, 40])
def test_boosted_margins(spark, rows, monkeypatch, cells):
    """Margins of boosted trees, also with the paths in many parts."""
    monkeypatch.setattr(tree_shap, "CELLS", cells)
    two = rows.where("label <> 'c2'")
    fitted = train.train(two, "id", FEATURES, "label", "GradientBoosting", n_trees=5)
    background = shap.background(two, "id", FEATURES, 6)
    some = two.where("id < 6")
    got = shap.shap_values(some, "id", fitted.scorer, background, "tree").where("class = 'c1'").collect()
    paths = tree_shap.model_paths(spark, tree_shap.fitted_trees(fitted.scorer), ["c0", "c1"])

    def margin(x):
        own = x[paths.feature]
        met = (paths.low < own) & (own <= paths.high)
        taken = np.ones(len(paths.values), bool)
        np.logical_and.at(taken, paths.path, met)
        return paths.values[taken, 1].sum()

    ready = {r["id"]: np.array([r[f] for f in FEATURES]) for r in shap.imputed(some, "id", fitted.scorer).collect()}
    for i, x in ready.items():
        wanted = plain(margin, x, np.array(background))
        assert np.allclose([r["phi"] for f in FEATURES for r in got if r["id"] == i and r["feature"] == f], wanted, atol=1e-9)
    scored = fitted.scorer.transform(some).select("id", F.get("probability", F.lit(1)).alias("p")).collect()
    for r in scored:
        assert r["p"] == pytest.approx(1 / (1 + np.exp(-2 * margin(ready[r["id"]]))), abs=1e-9)


def test_many_classes_and_refusals(spark, rows):
    fitted = train.train(rows, "id", FEATURES, "label", "GradientBoosting", n_trees=3)
    background = shap.background(rows, "id", FEATURES, 5)
    long = shap.shap_values(rows.where("id < 4"), "id", fitted.scorer, background, "tree")
    assert long.groupBy("class").count().count() == 3 and long.count() == 4 * 3 * 8
    with pytest.raises(ValueError):
        shap.shap_values(rows, "id", scoring.LinearScorer(FEATURES, ["a", "b"], [1.0] * 8, 0.0), background, "tree")
    assert shap.shap_values(rows.where("false"), "id", fitted.scorer, background, "tree").count() == 0
    with pytest.raises(ValueError):
        tree_shap.paths_of([[(i, 0.0, i + 1, 66 + i, [0.0]) for i in range(65)] + [(-1, 0.0, -1, -1, [1.0])] * 70], 1)


def test_leaf_alone_and_repeated_features(spark):
    stump = [[(-1, 0.0, -1, -1, [3.0])]]
    paths = tree_shap.paths_of(stump + [[(0, 2.0, 1, 2, [0.0]), (0, 1.0, 3, 4, [0.0]), (-1, 0.0, -1, -1, [5.0]), (-1, 0.0, -1, -1, [1.0]), (-1, 0.0, -1, -1, [2.0])]], 1)
    assert (np.bincount(paths.path, minlength=4) == [0, 1, 1, 1]).all()
    points = spark.createDataFrame([(0, [0.5, 9.0]), (1, [1.5, 9.0]), (2, [7.0, 9.0])], "id int, x array<double>")
    got = {(r["id"], r["feature"]): r["phi"] for r in tree_shap.path_shap(points, ["a", "b"], ["y"], paths, [[1.0, 0.0], [3.0, 0.0]]).collect()}
    assert got == {(0, "a"): -2.0, (1, "a"): -1.0, (2, "a"): 2.0, (0, "b"): 0.0, (1, "b"): 0.0, (2, "b"): 0.0}
