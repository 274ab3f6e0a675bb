"""Two models on the same rows: agreement zones, complementarity, metric table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mldiag.functions.columns import ref, same, share
from mldiag.operators.evaluate import metric_table

ZONES = ("both_correct", "both_wrong", "only_a_correct", "only_b_correct")


def join_predictions(
    model_a: DataFrame, model_b: DataFrame, id_col: str, prediction: str = "prediction"
) -> DataFrame:
    """Two prediction tables over the same rows as pred_a, pred_b (all other columns from A)."""
    left = model_a.withColumnRenamed(prediction, "pred_a")
    right = model_b.select(ref(id_col), ref(prediction).alias("pred_b"))
    return left.join(right, id_col)


def agreement_zones(
    df: DataFrame, label: str = "label", a: str = "pred_a", b: str = "pred_b"
) -> DataFrame:
    """Append `zone`: which of the two models is right."""
    ok_a, ok_b = same(ref(label), ref(a)), same(ref(label), ref(b))
    zone = (
        F.when(ok_a & ok_b, ZONES[0])
        .when(ok_a, ZONES[2])
        .when(ok_b, ZONES[3])
        .otherwise(ZONES[1])
    )
    return df.withColumn("zone", zone)


def zone_summary(zoned: DataFrame) -> DataFrame:
    """(zone, n, pct) for all four zones, empty ones included."""
    counts = zoned.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("zone") == z).alias(z) for z in ZONES],
    )
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(z).alias("zone"),
                        F.col(z).alias("n"),
                        F.round(share(F.col(z) * 100.0, F.col("total")), 1).alias("pct"),
                    )
                    for z in ZONES
                ]
            )
        )
    )


def complementarity(
    df: DataFrame, label: str = "label", a: str = "pred_a", b: str = "pred_b"
) -> DataFrame:
    """One row: accuracy of a perfect chooser between both models and its gain over the better one."""
    ok_a, ok_b = same(ref(label), ref(a)), same(ref(label), ref(b))
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(ok_a).alias("a"),
        F.count_if(ok_b).alias("b"),
        F.count_if(ok_a | ok_b).alias("u"),
    )
    best = F.greatest("a", "b")
    return counts.select(
        F.round(share(F.col("u"), F.col("n")), 6).alias("union_accuracy"),
        F.round(share(best, F.col("n")), 6).alias("best_single"),
        F.round(share(F.col("u") - best, F.col("n")), 6).alias("gain"),
    )


def arena_metrics(
    df: DataFrame,
    label: str = "label",
    a: str = "pred_a",
    b: str = "pred_b",
    positive: str | None = None,
) -> DataFrame:
    """(metric, model_a, model_b): weighted metrics, or binary ones when `positive` names a class."""
    one = metric_table(df, label, a, positive).withColumnRenamed("value", "model_a")
    two = metric_table(df, label, b, positive).withColumnRenamed("value", "model_b")
    return one.join(two, "metric")
