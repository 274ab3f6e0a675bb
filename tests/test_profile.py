import numpy as np
import pandas as pd
import pytest

from mldiag.operators import profile, roles, transforms


@pytest.fixture(scope="module")
def table():
    rng = np.random.RandomState(5)
    df = pd.DataFrame({"a": rng.normal(size=200), "b": rng.rand(200) * 10, "c": rng.randint(0, 9, 200).astype(float)})
    df.loc[[2, 7, 15], "a"] = np.nan
    df.loc[[5, 18], "b"] = np.nan
    df["label"] = np.where(rng.rand(200) > 0.4, "x", "y")
    return pd.concat([df, df.iloc[[0, 2]]], ignore_index=True)


def test_overview(spark, table):
    row = profile.overview(spark.createDataFrame(table)).first()
    assert row["samples"] == 202 and row["features"] == 3 and row["duplicates"] == 2
    assert row["missing_pct"] == round(table.isnull().sum().sum() / table.size * 100, 2)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a double, label string")
    assert profile.overview(empty).first()["samples"] == 0
    assert profile.missing_percent(empty).count() == 2
    assert profile.outliers(empty, ["a"]).count() == 0


def test_dtypes_and_missing(spark, table):
    got = profile.dtype_summary(spark.createDataFrame(table)).toPandas().set_index("column")
    assert got["unique_values"].to_dict() == {c: table[c].nunique(dropna=False) for c in table}
    assert got["missing_count"].to_dict() == table.isnull().sum().to_dict()


def test_correlation_is_pairwise_complete(spark, table):
    got = profile.correlation(spark.createDataFrame(table), ["a", "b", "c"]).toPandas()
    want = table[["a", "b", "c"]].corr()
    assert len(got) == 9
    assert all(abs(r.corr - want.loc[r.x, r.y]) <= 5.01e-4 for r in got.itertuples())
    with pytest.raises(ValueError):
        profile.correlation(spark.createDataFrame(table), ["a"])


@pytest.mark.parametrize("column", ["a", "b", "c", "flat"])
def test_histogram_equals_numpy(spark, table, column):
    df = table.assign(flat=3.0)
    got = profile.histogram(spark.createDataFrame(df), [column]).toPandas().sort_values("bin")
    counts, edges = np.histogram(df[column].dropna(), bins=20)
    assert got["n"].tolist() == counts.tolist() and np.allclose(got["lo"], edges[:-1], atol=1e-5)


def test_outliers_and_describe(spark, table):
    df = pd.concat([table, pd.DataFrame({"a": [500.0, -500.0]})], ignore_index=True)
    got = profile.outliers(spark.createDataFrame(df), ["a"]).first()
    s = df["a"].dropna()
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    assert got["q1"] == pytest.approx(q1, abs=1e-4)
    assert got["outlier_count"] == ((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum()
    row = profile.describe(spark.createDataFrame(df), ["b"]).first()
    want = df["b"].describe()
    for mine, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p50", "50%"), ("max", "max")):
        assert row[mine] == pytest.approx(want[theirs], abs=5.1e-4)


def test_scaling_uses_the_population_deviation(spark, table):
    df = table[["c"]].assign(flat=2.0)
    got = transforms.normalize(spark.createDataFrame(df), "standard").toPandas()
    assert got["c"].std(ddof=0) == pytest.approx(1) and (got["flat"] == 0).all()
    got = transforms.normalize(spark.createDataFrame(df), "minmax").toPandas()
    assert got["c"].min() == 0 and got["c"].max() == 1 and (got["flat"] == 0).all()


def test_imputation(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (4.0, None)], "a double, b double")
    assert [tuple(r) for r in transforms.impute_mean(df).collect()] == [(1.0, 0.0), (2.5, 0.0), (4.0, 0.0)]


def test_decode(spark):
    df = spark.createDataFrame([(0,), (2,), (9,)], "target int")
    assert [r["label"] for r in transforms.decode_target(df, "target", ["a", "b", "c"]).collect()] == ["a", "c", None]


@pytest.mark.parametrize(
    "schema, rows, label",
    [
        ("x double, label string", [(1.0, "a")], "label"),
        ("x double, Species string", [(1.0, "a")], "Species"),
        ("target int, class string", [(1, "a")], "target"),
        ("id int, grp string", [(1, "a"), (2, "b")], "grp"),
        ("x double, only string", [(1.0, "a")], None),
    ],
)
def test_label_guess(spark, schema, rows, label):
    assert roles.infer_columns(spark.createDataFrame(rows, schema)).label == label


def test_text_image_and_features(spark):
    df = spark.createDataFrame([("w" * 60, "s", "/a.png", 1, 2.0)], "t string, s string, image string, target int, f double")
    found = roles.infer_columns(df)
    assert (found.text, found.image, found.features) == ("t", "image", ["f"])


def test_training_checks(spark):
    df = spark.createDataFrame([(1.0, "a")] * 4, "x double, label string")
    got = {r["check"]: r["ok"] for r in roles.training_check(df, ["x", "nope"], "label").collect()}
    assert got["label_present"] and not got["features_present"] and not got["min_samples"] and not got["classes"]
