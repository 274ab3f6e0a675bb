"""The composed analyses, held against the SQL of the tables they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from mldiag.operators import drift as drift_ops
from mldiag.plans import drift_queries, model_queries, workflows
from mldiag.plans.model_queries import centroid_scorer, vectors
from mldiag.plans.registry import ORACLES, query, table


@query("workflow_drift", ORACLES["drift_scores"])
def workflow_drift(spark, folder):
    before, after = drift_ops.split_at(table(spark, folder, "lineitem"), "l_shipdate", drift_queries._boundary())
    return workflows.drift(before, after, drift_queries.FEATURES).scores


@query("workflow_drift_temporal", ORACLES["drift_temporal"])
def workflow_drift_temporal(spark, folder):
    events = table(spark, folder, "events")
    return workflows.drift(events, events, ["value", "user_id"], "ts", "event_id").temporal


@query("workflow_evaluate", ORACLES["class_metrics"])
def workflow_evaluate(spark, folder):
    rows = vectors(spark, folder)
    return workflows.evaluate(rows, centroid_scorer(rows), "vec_id", "label").classes


@query("workflow_evaluate_auc", ORACLES["roc_auc_multiclass"])
def workflow_evaluate_auc(spark, folder):
    rows = vectors(spark, folder)
    return workflows.evaluate(rows, centroid_scorer(rows), "vec_id", "label").auc


@query("workflow_compare", ORACLES["zone_summary"])
def workflow_compare(spark, folder):
    rows = vectors(spark, folder)
    return workflows.compare(rows, centroid_scorer(rows), centroid_scorer(rows, "cosine"), "label").zones


@query(
    "scored_batches",
    """SELECT p_partkey, round(p, 6) AS probability, CASE WHEN p > 1.0 - p THEN '1' ELSE '0' END AS prediction
FROM (SELECT p_partkey, 1.0 / (1.0 + exp(-(-18.0::DOUBLE + 0.08::DOUBLE * p_size + 0.02::DOUBLE * p_retailprice))) AS p FROM part)""",
)
def scored_batches(spark, folder):
    """A model given as a function on matrices."""
    import numpy as np

    from mldiag.operators.scoring import BatchScorer

    def model(x):
        p = 1.0 / (1.0 + np.exp(-(-18.0 + 0.08 * x[:, 0] + 0.02 * x[:, 1])))
        return np.stack([1.0 - p, p], axis=1)

    part = table(spark, folder, "part")
    scored = BatchScorer(["p_size", "p_retailprice"], ["0", "1"], model).transform(part)
    return scored.select("p_partkey", F.round(F.col("probability")[1], 6).alias("probability"), "prediction")


@query("scored_pipeline", "SELECT 'v' || vec_id AS key, true AS sums_to_one, true AS best_wins FROM embeddings")
def scored_pipeline(spark, folder):
    """A fitted pipeline on rows with missing values."""
    rows, features = model_queries.embedded_features(spark, folder)
    from mldiag.operators import train

    fitted = train.train(rows, "key", features, "label", "LogisticRegression", max_iter=20)
    scored = fitted.scorer.transform(rows)
    names = F.array(*[F.lit(c) for c in fitted.scorer.classes])
    total = F.aggregate("probability", F.lit(0.0), lambda s, p: s + p)
    best = F.get(names, (F.array_position("probability", F.array_max("probability")) - 1).cast("int"))
    return scored.select("key", (F.abs(total - 1) < 1e-9).alias("sums_to_one"), (best == F.col("prediction")).alias("best_wins"))
