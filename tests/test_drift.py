import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import mldiag
from mldiag.operators import drift
from mldiag.streaming import drift_stream


def psi(reference, production, bins=10):
    edges = np.percentile(reference, np.linspace(0, 100, bins + 1))
    inner = np.unique(edges[1:-1])
    count = lambda v: np.bincount(np.searchsorted(inner, v, side="right"), minlength=len(inner) + 1) / len(v)
    r, p = np.maximum(count(reference), 1e-6), np.maximum(count(production), 1e-6)
    return max(0.0, float(((p - r) * np.log(p / r)).sum()))


def ks(a, b):
    grid = np.concatenate([a, b])
    ecdf = lambda v: np.searchsorted(np.sort(v), grid, side="right") / len(v)
    return np.abs(ecdf(a) - ecdf(b)).max()


@pytest.fixture(scope="module")
def sides():
    rng = np.random.RandomState(3)
    a = pd.DataFrame({"f1": rng.normal(0, 1, 300), "f2": rng.randint(0, 6, 300).astype(float), "f3": rng.rand(300)})
    b = pd.DataFrame({"f1": rng.normal(2, 1, 200), "f2": rng.randint(0, 6, 200).astype(float), "f3": rng.rand(200) + 0.5})
    a.loc[::7, "f3"] = np.nan
    return a, b


def test_scores_match_the_definitions(spark, sides):
    a, b = sides
    got = drift.drift_scores(spark.createDataFrame(a), spark.createDataFrame(b)).toPandas().set_index("feature")
    for f in a:
        x, y = a[f].dropna().to_numpy(), b[f].to_numpy()
        assert got.loc[f, "ks_statistic"] == pytest.approx(ks(x, y), abs=1e-4)
        assert got.loc[f, "psi"] == pytest.approx(psi(x, y), abs=1e-4)
    assert got["drift"].to_dict() == {"f1": "Yes", "f2": "No", "f3": "Yes"}


def test_same_table_has_no_drift(spark, sides):
    df = spark.createDataFrame(sides[0])
    got = drift.drift_scores(df, df).toPandas()
    assert (got["ks_statistic"] == 0).all() and (got["psi"] == 0).all() and (got["ks_pvalue"] == 1).all()


def test_missing_and_disjoint_features_are_skipped(spark):
    a = spark.createDataFrame([(1.0, None, float("nan"))], "x double, y double, z double")
    b = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    assert [r["feature"] for r in drift.drift_scores(a, b).collect()] == ["x"]
    assert drift.drift_features(a, b.drop("x")) == ["y", "z"]


def test_constant_reference(spark):
    a = spark.createDataFrame([(5.0,)] * 20, "x double")
    b = spark.createDataFrame([(5.0,)] * 10 + [(4.0,)] * 10, "x double")
    row = drift.drift_scores(a, b).first()
    assert row["ks_statistic"] == 0.5 and row["psi"] == pytest.approx(psi(np.full(20, 5.0), np.array([5.0, 4.0] * 10)), abs=1e-3)


def test_windows_over_time(spark, sides):
    a, b = sides
    b = b.assign(ts=np.arange(len(b))[::-1], i=np.arange(len(b)))
    report = mldiag.drift(spark.createDataFrame(a), spark.createDataFrame(b), ["f1", "f2"], "ts", "i")
    got = report.temporal.toPandas().sort_values("window").reset_index(drop=True)
    ordered = b.sort_values("ts")
    want = [
        [ks(a[f].to_numpy(), ordered.iloc[idx][f].to_numpy()) for f in ("f1", "f2")]
        for idx in np.array_split(range(len(b)), 20)
    ]
    assert np.allclose(got["mean_ks"], np.mean(want, axis=1), atol=1e-4)
    assert np.allclose(got["max_ks"], np.max(want, axis=1), atol=1e-4)


def test_too_few_rows_for_windows(spark):
    df = spark.createDataFrame([(float(i), i, i) for i in range(19)], "x double, ts int, i int")
    assert drift.temporal_drift(df, df, "ts", "i", ["x"]).count() == 0


def test_density_integrates_to_one(spark, sides):
    curves = drift.side_densities(spark.createDataFrame(sides[0]), spark.createDataFrame(sides[1]), ["f1"]).toPandas()
    for _, c in curves.groupby("side"):
        c = c.sort_values("x")
        assert len(c) == 100 and 0.9 < np.trapezoid(c["density"], c["x"]) <= 1.01


def test_late_rows_are_dropped_and_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-0{d} 0{h}:00:00", float(d + h)) for d in (1, 2, 3) for h in range(5)]
    frame = lambda part: spark.createDataFrame(part, "ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    late = ("2023-12-01 00:00:00", 4.0)
    # rows are late by the watermark of the batch before; the last file moves it past every window
    for number, part in enumerate((rows[:8], rows[8:12], [*rows[12:], late], [("2030-01-01 00:00:00", 4.0)])):
        frame(part).coalesce(1).write.parquet(str(tmp_path / "in" / str(number)))
    reader = spark.readStream.schema(frame(rows).schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1)
    counts = drift_stream.bin_counts(reader.parquet(str(tmp_path / "in")), "ts", {"value": [3.0, 5.0]})
    run = (
        counts.writeStream.format("parquet")
        .outputMode("append")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    key = lambda df: sorted(map(tuple, df.collect()))
    got = key(spark.read.parquet(str(tmp_path / "out")))
    assert got == key(drift_stream.bin_counts(frame(rows), "ts", {"value": [3.0, 5.0]}))
    assert key(drift_stream.bin_counts(frame([*rows, late]), "ts", {"value": [3.0, 5.0]})) != got


def test_no_feature_is_left_out_of_temporal_drift(spark):
    rows = pd.DataFrame({f"f{i}": [float(k % 3) for k in range(60)] for i in range(5)})
    rows["f5"] = [0.0 if k < 30 else 9.0 for k in range(60)]
    rows["ts"] = pd.date_range("2024-01-01", periods=60, freq="h")
    rows["i"] = range(60)
    df = spark.createDataFrame(rows)
    names = [f"f{i}" for i in range(6)]
    found = drift.temporal_drift(df.where("i < 30"), df, "ts", "i", names).toPandas()
    assert found["max_ks"].max() == 1.0
    assert drift.temporal_drift(df, df, "ts", "i", names, max_windows=3).count() == 3
