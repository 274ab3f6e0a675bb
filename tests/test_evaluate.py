import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import mldiag
from mldiag.operators import compare, evaluate, scoring

CLASSES = ["cat", "dog", "fish"]


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.RandomState(7)
    n = 120
    p = rng.dirichlet(np.ones(3), n).round(2)
    label = rng.choice(CLASSES, n)
    pdf = pd.DataFrame({"id": range(n), "label": label, "probability": list(p.tolist()), "x": rng.rand(n), "y": rng.rand(n)})
    pdf["prediction"] = [CLASSES[i] for i in p.argmax(1)]
    pdf["other"] = rng.choice(CLASSES, n)
    pdf["cluster"] = ["0", "1"] * (n // 2)
    return pdf, spark.createDataFrame(pdf).cache()


def test_confusion_is_dense_and_complete(scored):
    pdf, df = scored
    got = evaluate.confusion_matrix(df).toPandas()
    want = pd.crosstab(pdf["label"], pdf["prediction"])
    assert len(got) == 9 and got["n"].sum() == len(pdf)
    assert all(want.loc[r.true, r.predicted] == r.n for r in got.itertuples())
    fixed = evaluate.confusion_matrix(df, class_names=CLASSES + ["bird"]).toPandas()
    assert len(fixed) == 16 and fixed[fixed["true"] == "bird"]["n"].sum() == 0


def test_metrics(scored):
    pdf, df = scored
    got = evaluate.class_metrics(df).toPandas().set_index("class")
    for c in CLASSES:
        t, p = pdf["label"] == c, pdf["prediction"] == c
        assert got.loc[c, "precision"] == pytest.approx((t & p).sum() / p.sum(), abs=1e-6)
        assert got.loc[c, "recall"] == pytest.approx((t & p).sum() / t.sum(), abs=1e-6)
    row = evaluate.weighted_metrics(df).first()
    assert row["accuracy"] == pytest.approx((pdf["label"] == pdf["prediction"]).mean(), abs=1e-6)
    assert row["recall"] == row["accuracy"]


def test_classes_without_predictions_score_zero(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b")], "label string, prediction string")
    assert [tuple(r)[2:] for r in evaluate.class_metrics(df).orderBy("class").collect()] == [(0, 0, 0), (0, 0, 0)]
    assert evaluate.binary_metrics(df, "a").first()["f1"] == 0


def test_roc(scored):
    pdf, df = scored
    auc = {r["class"]: r["auc"] for r in evaluate.roc_auc(df, CLASSES).collect()}
    flipped = df.withColumn("probability", F.transform("probability", lambda p: -p))
    mirror = {r["class"]: r["auc"] for r in evaluate.roc_auc(flipped, CLASSES).collect()}
    points = evaluate.roc_points(df, CLASSES).toPandas()
    for i, c in enumerate(CLASSES):
        s, t = np.array(pdf["probability"].tolist())[:, i], (pdf["label"] == c).to_numpy()
        pairs = s[t][:, None] - s[~t][None, :]
        assert auc[c] == pytest.approx((pairs > 0).mean() + 0.5 * (pairs == 0).mean(), abs=1e-6)
        assert auc[c] + mirror[c] == pytest.approx(1, abs=2e-6)
        curve = points[points["class"] == c].sort_values(["fpr", "tpr"])
        assert curve.iloc[0][["fpr", "tpr"]].tolist() == [0, 0] and curve.iloc[-1][["fpr", "tpr"]].tolist() == [1, 1]
        assert np.trapezoid(curve["tpr"], curve["fpr"]) == pytest.approx(auc[c], abs=1e-4)


def test_one_sided_class_has_no_curve(scored):
    _, df = scored
    only = df.where("label = 'cat'")
    assert evaluate.roc_auc(only, CLASSES).count() == 0 and evaluate.roc_points(only, CLASSES).count() == 0


def test_hardest_and_pairs(scored):
    pdf, df = scored
    rows = evaluate.hardest_samples(df, "id").toPandas()
    assert len(rows) == len(pdf) and rows["margin"].is_monotonic_increasing
    plain = evaluate.hardest_samples(df.drop("probability"), "id", limit=3).toPandas()
    assert (plain["margin"] == 1).all() and len(plain) == 3
    pairs = evaluate.confusion_pairs(df, top=2).toPandas()
    assert len(pairs) == 2 and (pairs["true"] != pairs["predicted"]).all()


def test_zones(scored):
    pdf, df = scored
    both = df.withColumnsRenamed({"prediction": "pred_a", "other": "pred_b"})
    zoned = compare.agreement_zones(both)
    summary = compare.zone_summary(zoned).toPandas()
    assert len(summary) == 4 and summary["n"].sum() == len(pdf) and summary["pct"].sum() == pytest.approx(100, abs=0.3)
    gain = compare.complementarity(both).first()
    assert gain["gain"] >= 0 and gain["union_accuracy"] >= gain["best_single"]
    assert compare.arena_metrics(both).count() == 4


def test_clusters_and_selection(scored):
    pdf, df = scored
    got = evaluate.error_rate_by_cluster(df).toPandas().set_index("cluster")
    wrong = pdf["label"] != pdf["prediction"]
    assert got["errors"].to_dict() == wrong.groupby(pdf["cluster"]).sum().to_dict()
    assert evaluate.cluster_summary(df).toPandas()["pct"].sum() == pytest.approx(100)
    picked = df.where("id < 5").select("id")
    assert evaluate.select_rows(df, picked.union(picked), "id").count() == 5
    assert evaluate.detail_table(df.withColumn("target", F.lit(1)), "id", 3, 2).collect()[0].asDict().keys() == {"id", "label", "probability"}
    cell = evaluate.confusion_cell(df, "cat", "dog")
    assert cell.count() == ((pdf["label"] == "cat") & (pdf["prediction"] == "dog")).sum()
    assert set(evaluate.plot_frame(df, "id").columns) == {"id", "x", "y", "label", "prediction", "confidence", "cluster", "error"}
    assert evaluate.raster(df, width=4, height=4).agg(F.sum("n")).first()[0] == len(pdf)


def test_workflows(scored):
    _, df = scored
    a = scoring.LinearScorer(["x", "y"], [1.0, -1.0], 0.0, ["cat", "dog"])
    b = scoring.BatchScorer(["x", "y"], ["cat", "dog"], lambda m: np.stack([m[:, 0], 1 - m[:, 0]], 1))
    plain = df.select("id", "label", "x", "y")
    assert mldiag.compare(plain, a, b, "label").zones.count() == 4
    report = mldiag.evaluate(plain, a, "id", "label")
    assert report.confusion.count() == 4 and report.hardest.count() == 100 and report.auc.count() == 2


def test_numbers_and_text_labels_agree(spark):
    df = spark.createDataFrame([(1, "1"), (0, "1"), (None, "1")], "label int, prediction string")
    assert evaluate.accuracy(df).first()["correct"] == 1
