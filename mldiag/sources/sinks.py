"""Sinks for annotations and analysis snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mldiag.functions.columns import ref, same
from mldiag.operators.profile import describe
from mldiag.operators.shap import importance


def write_labels_csv(labels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    labels.write.mode(mode).option("header", True).csv(path)


def write_labels_json(labels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON record per line."""
    labels.write.mode(mode).json(path)


def _accuracy(df: DataFrame, label: str | None, prediction: str | None):
    if label is None or prediction is None:
        return F.lit(None).cast("double")
    hits = F.count_if(same(ref(label), ref(prediction)))
    return F.round(F.try_divide(hits, F.count(F.lit(1))), 6)


def snapshot(
    df: DataFrame,
    dataset_name: str,
    features: Sequence[str],
    label: str | None = None,
    prediction: str | None = None,
    class_names: Sequence[str] = (),
    model_name: str = "",
    embedding_method: str = "",
    reduction_method: str = "",
    cluster_col: str | None = None,
    annotations: DataFrame | None = None,
    selected: DataFrame | None = None,
    models_trained: Sequence[str] = (),
) -> DataFrame:
    """One row describing the state of an analysis; clusters, annotations and selected rows are counted."""
    size = lambda rows: F.lit(0) if rows is None else rows.agg(F.count(F.lit(1))).scalar()
    n_clusters = F.count_distinct(ref(cluster_col)) if cluster_col else F.lit(0)
    text = lambda items: F.lit(",".join(items))
    return df.agg(
        F.lit(dataset_name).alias("dataset_name"),
        F.count(F.lit(1)).alias("n_samples"),
        F.lit(len(features)).cast("bigint").alias("n_features"),
        text(features).alias("feature_columns"),
        F.lit(label or "").alias("label_column"),
        text(class_names).alias("class_names"),
        F.lit(model_name).alias("model_name"),
        F.lit(embedding_method).alias("embedding_method"),
        F.lit(reduction_method).alias("reduction_method"),
        n_clusters.cast("bigint").alias("n_clusters"),
        F.max(size(annotations)).cast("bigint").alias("n_annotations"),
        F.max(size(selected)).cast("bigint").alias("n_selected"),
        _accuracy(df, label, prediction).alias("accuracy"),
        text(models_trained).alias("models_trained"),
    )


def write_snapshot(row: DataFrame, path: str, mode: str = "errorifexists") -> None:
    row.write.mode(mode).json(path)


def analysis_summary(
    df: DataFrame,
    features: Sequence[str],
    label: str | None = None,
    prediction: str | None = None,
    selected: DataFrame | None = None,
    shap_long: DataFrame | None = None,
) -> DataFrame:
    """(section, key, value) rows: sizes, accuracy, statistics of the selection, its top features."""
    counts = df.agg(
        F.count(F.lit(1)).cast("double").alias("samples"),
        F.lit(float(len(features))).alias("features"),
        (F.count_distinct(ref(label)) if label else F.lit(0)).cast("double").alias("classes"),
        _accuracy(df, label, prediction).alias("accuracy"),
    )
    rows = counts.unpivot([], counts.columns, "key", "value").select(F.lit("dataset").alias("section"), "key", "value")
    if selected is not None:
        size = selected.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
            F.lit("selection").alias("section"), F.lit("selected").alias("key"), "value"
        )
        stats = describe(selected, features)
        names = [c for c in stats.columns if c != "feature"]
        cells = stats.select("feature", *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
            "feature", names, "stat", "value"
        )
        rows = rows.unionByName(size).unionByName(
            cells.select(
                F.lit("selection").alias("section"),
                F.concat_ws(".", "feature", "stat").alias("key"),
                "value",
            )
        )
    if shap_long is not None:
        top = importance(shap_long, 5)
        rows = rows.unionByName(
            top.select(
                F.lit("top_shap").alias("section"), F.col("feature").alias("key"), F.col("mean_abs_phi").alias("value")
            )
        )
    return rows.where(F.col("value").isNotNull())
