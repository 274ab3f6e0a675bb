import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mldiag.operators import counterfactual, scoring, shap, train

FEATURES = ["a", "b", "c"]


def _logistic():
    def score(m):  # a nested function travels to the workers by value
        z = 1.5 * m[:, 0] - m[:, 1] * m[:, 2] + 0.2
        p = 1 / (1 + np.exp(-z))
        return np.stack([1 - p, p], 1)

    return score


logistic = _logistic()


def expression(values):
    a, b, c = values
    z = F.lit(1.5) * a - b * c + F.lit(0.2)
    p = 1 / (1 + F.exp(-z))
    return F.array(1 - p, p)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.RandomState(9)
    x = rng.normal(size=(40, 3))
    pdf = pd.DataFrame(x, columns=FEATURES).assign(id=range(40))
    pdf["label"] = np.where(logistic(x)[:, 1] + rng.normal(0, 0.1, 40) > 0.5, "1", "0")
    return x, spark.createDataFrame(pdf).cache()


def scorers():
    return scoring.ExprScorer(FEATURES, ["0", "1"], expression), scoring.BatchScorer(FEATURES, ["0", "1"], logistic)


def test_attributions_add_up_and_agree(spark, data):
    x, df = data
    expr, batch = scorers()
    rows = shap.background(df, "id", FEATURES, 10)
    assert rows == shap.background(df.repartition(6), "id", FEATURES, 10)
    one = shap.exact_shap(df, "id", expr, rows).toPandas().sort_values(["id", "class", "feature"])
    two = shap.batch_shap(df, "id", batch, rows).toPandas().sort_values(["id", "class", "feature"])
    assert np.allclose(one["phi"], two["phi"]) and np.allclose(one["value"], two["value"])
    base = {r["class"]: r["base"] for r in shap.base_values(expr, spark, rows).collect()}
    sums = one[one["class"] == "1"].groupby("id")["phi"].sum()
    assert np.allclose(sums, logistic(x)[:, 1] - base["1"])
    rough = shap.sampled_shap(df, "id", expr, rows, 100).toPandas()
    total = rough[rough["class"] == "1"].groupby("id")["phi"].sum()
    assert np.allclose(total, logistic(x)[:, 1] - base["1"])


def test_many_features_are_sampled(spark):
    names = [f"f{i}" for i in range(12)]
    rng = np.random.RandomState(0)
    df = spark.createDataFrame(pd.DataFrame(rng.rand(5, 12), columns=names).assign(id=range(5)))
    weights = rng.normal(size=12)
    score = scoring.BatchScorer(names, ["s"], lambda m: (m @ weights)[:, None])
    rows = shap.background(df, "id", names)
    got = shap.shap_values(df, "id", score, rows, "sampled").toPandas()
    linear = scoring.ExprScorer(names, ["s"], lambda v: F.array(sum((F.lit(float(w)) * c for w, c in zip(weights, v)), F.lit(0.0))))
    other = shap.shap_values(df, "id", linear, rows, "sampled").toPandas()
    key = ["id", "feature"]
    assert np.allclose(got.sort_values(key)["phi"], other.sort_values(key)["phi"])
    with pytest.raises(ValueError):
        shap.exact_shap(df, "id", linear, rows)
    with pytest.raises(ValueError):
        shap.shap_values(df, "id", score, rows)


def test_missing_values_and_repeated_ids(spark):
    rows = [("a", 1.0, 2.0), ("a", 3.0, None), ("b", None, 4.0), ("c", 5.0, 6.0)]
    df = spark.createDataFrame(rows, "id string, a double, b double")
    linear = scoring.ExprScorer(["a", "b"], ["s"], lambda v: F.array(F.lit(2.0) * v[0] - v[1]))
    matrix = scoring.BatchScorer(["a", "b"], ["s"], lambda m: (2.0 * m[:, 0] - m[:, 1])[:, None])
    background = shap.background(df, "id", ["a", "b"])
    assert sorted(background) == [[1.0, 2.0], [3.0, 4.0], [3.0, 4.0], [5.0, 6.0]]
    for found in (
        shap.exact_shap(df, "id", linear, background),
        shap.sampled_shap(df, "id", linear, background, 8),
        shap.batch_shap(df, "id", matrix, background),
        shap.batch_shap(df, "id", matrix, background, 8, method="sampled"),
    ):
        got = sorted((r["id"], r["feature"], round(r["value"], 9), round(r["phi"], 9)) for r in found.collect())
        wanted = []
        for i, a, b in rows:
            a, b = a if a is not None else 3.0, b if b is not None else 4.0
            wanted += [(i, "a", a, 2.0 * (a - 3.0)), (i, "b", b, -(b - 4.0))]
        assert got == sorted((i, f, v, p + 0.0) for i, f, v, p in wanted)


def test_linear_attributions(data):
    x, df = data
    linear = scoring.LinearScorer(FEATURES, [1.0, -2.0, 0.5], 0.3)
    got = shap.shap_values(df, "id", linear).toPandas().pivot(index="id", columns="feature", values="phi")
    assert np.allclose(got[FEATURES].to_numpy(), (x - x.mean(0)) * [1.0, -2.0, 0.5])
    base = shap.linear_base(df, linear).first()["base"]
    assert base == pytest.approx(x.mean(0) @ [1.0, -2.0, 0.5] + 0.3)


def test_tables_from_attributions(data):
    _, df = data
    expr, _ = scorers()
    rows = shap.background(df, "id", FEATURES, 5)
    long = shap.reduce_classes(shap.exact_shap(df, "id", expr, rows), "first", "1").cache()
    top = shap.importance(long, 2).toPandas()
    assert len(top) == 2 and top["mean_abs_phi"].is_monotonic_decreasing
    fall = shap.waterfall(long, 2).toPandas()
    assert fall.groupby("id").size().eq(2).all()
    assert (fall[fall["rank"] == 1].set_index("id")["phi"].abs() >= fall[fall["rank"] == 2].set_index("id")["phi"].abs()).all()
    spread = shap.distribution(long, 2).toPandas()
    assert spread["normalised"].between(0, 1).all() and set(spread["rank"]) == {0, 1}
    assert shap.distribution(long.where("id < 4"), min_rows=5).count() == 0
    assert shap.distribution(long.where("id < 4")).count() > 0
    assert shap.dependence(long, "a", "a").columns == ["id", "value", "phi"]
    assert shap.append_shap(df, "id", None, FEATURES) is df
    assert "shap_b" in shap.append_shap(df, "id", long, FEATURES).columns
    assert shap.explained_rows(df, "id", None, 7).count() == 7
    assert shap.explained_rows(df, "id", df.where("id > 30")).count() == 9
    mean = shap.reduce_classes(shap.exact_shap(df, "id", expr, rows), "mean").toPandas()
    assert np.allclose(mean["phi"], 0)


def test_flips_really_flip(data):
    x, df = data
    expr, batch = scorers()
    found = counterfactual.minimum_flip(df, "id", expr).toPandas().set_index("id")
    again = counterfactual.minimum_flip(df, "id", batch).toPandas().set_index("id")
    assert found.sort_index().equals(again.sort_index())
    lo, hi = x.min(0), x.max(0)
    lo, hi = lo - (hi - lo) * 0.1, hi + (hi - lo) * 0.1
    own = logistic(x)[:, 1] > 0.5
    for i in range(len(x)):
        best = None
        for j in range(3):
            for end in (hi[j], lo[j]):
                for value in np.linspace(x[i, j], end, 50):
                    m = x[i].copy()
                    m[j] = value
                    if (logistic(m[None])[0, 1] > 0.5) != own[i]:
                        step = abs(value - x[i, j])
                        best = step if best is None else min(best, step)
                        break
        assert (best is None) == (i not in found.index)
        if best is not None:
            assert found.loc[i, "change"] == pytest.approx(best, abs=1e-5)


def test_constant_feature_gets_its_own_range(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.0)], "id int, a double")
    linear = scoring.LinearScorer(["a"], [1.0], -1.1)
    got = counterfactual.sweep(df, "id", linear).collect()
    assert len(got) == 2 and all(1.1 < r["flip_value"] <= 1.2 for r in got)


def test_what_if(data):
    _, df = data
    expr, _ = scorers()
    got = counterfactual.what_if(df, "id", expr, {"a": F.col("a") + 5, "b": F.col("b")}).toPandas()
    assert set(got["changed"]) == {"a"} and len(got) == 80
    assert np.allclose(got.groupby("id")["delta"].sum(), 0, atol=2e-6)


def test_fitted_pipelines_are_explained_too(spark, data):
    _, df = data
    fitted = train.train(df, "id", FEATURES, "label", "RandomForest", n_trees=3, max_depth=3)
    assert fitted.metrics.first()["n_train"] + fitted.metrics.first()["n_test"] == 40
    few = df.where("id < 4")
    rows = shap.background(df, "id", FEATURES, 4)
    long = shap.shap_values(few, "id", fitted.scorer, rows).toPandas()
    base = {r["class"]: r["base"] for r in shap.base_values(fitted.scorer, spark, rows).collect()}
    proba = {r["id"]: r["probability"][1] for r in fitted.scorer.transform(few).collect()}
    sums = long[long["class"] == "1"].groupby("id")["phi"].sum()
    assert all(sums[i] == pytest.approx(proba[i] - base["1"]) for i in proba)
    assert counterfactual.minimum_flip(few, "id", fitted.scorer, df, 11).count() <= 4


@pytest.mark.parametrize("model, options", [
    ("LogisticRegression", {}), ("GradientBoosting", {"n_trees": 3}), ("SVM", {"n_components": 20, "max_iter": 5}), ("KNN", {}),
])
def test_every_model_trains_on_three_classes(spark, model, options):
    rng = np.random.RandomState(1)
    x = np.concatenate([rng.normal(c, 0.3, (30, 2)) for c in (0, 3, 6)])
    pdf = pd.DataFrame(x, columns=["p", "q"]).assign(id=range(90), label=[c for c in "abc" for _ in range(30)])
    pdf.loc[0, "p"] = np.nan
    out = train.train(spark.createDataFrame(pdf), "id", ["p", "q"], "label", model, **options)
    row = out.metrics.first()
    assert row["n_test"] == 18 and row["n_train"] == 72 and row["accuracy"] > 0.8
    assert all(abs(sum(r["probability"]) - 1) < 1e-6 for r in out.scored.select("probability").collect())


def test_split_is_stratified_and_stable(data):
    _, df = data
    one = {r["id"]: r["split"] for r in train.stratified_split(df, "id", "label", 0.25).collect()}
    two = {r["id"]: r["split"] for r in train.stratified_split(df.repartition(3), "id", "label", 0.25).collect()}
    assert one == two
    with pytest.raises(ValueError):
        train.train(df.where("label = '1'"), "id", FEATURES, "label")
    with pytest.raises(ValueError):
        train.train(df, "id", FEATURES, "label", "Perceptron")
