"""The composed analyses a user starts from."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mldiag.operators import compare as arena
from mldiag.operators import drift as drift_ops
from mldiag.operators import evaluate as ev
from mldiag.operators.embed import embed
from mldiag.operators.neighbors import auto_cluster
from mldiag.operators.reduce import reduce2d
from mldiag.operators.roles import Roles, infer_columns
from mldiag.operators.scoring import Scorer


@dataclass
class Exploration:
    roles: Roles
    frame: DataFrame


def explore(
    df: DataFrame,
    id_col: str,
    label: str | None = None,
    text: str | None = None,
    embedding: str | None = None,
    method: str = "tfidf",
    reduction: str = "pca",
    n_clusters: int = 5,
) -> Exploration:
    """Roles, embedding, 2-D coordinates and clusters of a table. Explicit names win over guesses."""
    guessed = infer_columns(df)
    roles = Roles(
        label=label or guessed.label,
        text=text or guessed.text,
        image=guessed.image,
        features=[f for f in guessed.features if f not in (id_col, label)],
    )
    if embedding is not None:
        rows = df.withColumn("embedding", F.col(embedding))
    elif roles.text is not None and method == "tfidf":
        rows = embed(df, "tfidf", id_col, roles.text)
    else:
        from mldiag.operators.transforms import feature_embedding

        rows = feature_embedding(df, roles.features)
    placed = reduce2d(rows, reduction, "embedding", id_col=id_col)
    return Exploration(roles, auto_cluster(placed, id_col, n_clusters))


@dataclass
class DriftReport:
    scores: DataFrame
    temporal: DataFrame | None


def drift(
    reference: DataFrame,
    production: DataFrame,
    features: Sequence[str] | None = None,
    timestamp_col: str | None = None,
    id_col: str | None = None,
) -> DriftReport:
    """Feature drift scores, and drift over time when a time and an id column are named."""
    temporal = None
    if timestamp_col and timestamp_col in production.columns and id_col:
        temporal = drift_ops.temporal_drift(reference, production, timestamp_col, id_col, features)
    return DriftReport(drift_ops.drift_scores(reference, production, features, timestamp_col), temporal)


@dataclass
class Evaluation:
    confusion: DataFrame
    classes: DataFrame
    weighted: DataFrame
    pairs: DataFrame
    hardest: DataFrame
    auc: DataFrame


def evaluate(df: DataFrame, scorer: Scorer, id_col: str, label: str, hardest: int = 100) -> Evaluation:
    """Score a table and derive every evaluation table from the scored rows."""
    scored = scorer.transform(df)
    return Evaluation(
        ev.confusion_matrix(scored, label, class_names=scorer.classes),
        ev.class_metrics(scored, label),
        ev.weighted_metrics(scored, label),
        ev.confusion_pairs(scored, label),
        ev.hardest_samples(scored, id_col, label, limit=hardest),
        ev.roc_auc(scored, scorer.classes, label),
    )


@dataclass
class Comparison:
    rows: DataFrame
    zones: DataFrame
    gain: DataFrame
    metrics: DataFrame


def compare(df: DataFrame, model_a: Scorer, model_b: Scorer, label: str) -> Comparison:
    """Two scorers on one table, chained over a single scan."""
    first = model_a.transform(df).withColumnsRenamed(
        {"prediction": "pred_a", "probability": "probability_a"}
    )
    both = model_b.transform(first).withColumnsRenamed(
        {"prediction": "pred_b", "probability": "probability_b"}
    )
    zoned = arena.agreement_zones(both, label)
    return Comparison(
        zoned, arena.zone_summary(zoned), arena.complementarity(zoned, label), arena.arena_metrics(zoned, label)
    )
