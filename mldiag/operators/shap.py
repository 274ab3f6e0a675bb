"""Shapley attributions in long form (id, class, feature, phi, value) and the tables drawn from them.

Attributions are interventional: a feature outside a coalition takes its value from a background of
at most 100 sampled rows. The background and the coalition weights travel as literals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mldiag.functions.columns import as_double, literal_matrix, literal_vector, ref
from mldiag.operators.scale import hash_sample, spread
from mldiag.operators.scoring import BatchScorer, ExprScorer, LinearScorer, Scorer
from mldiag.operators.tree_shap import fitted_trees, tree_shap

BACKGROUND_ROWS = 100
MAX_EXACT = 10


def imputed(df: DataFrame, id_col: str, scorer: Scorer) -> DataFrame:
    """Id (as `id`, any type), a row key, and the features as doubles without nulls.

    A missing value becomes the mean the fitted model imputes, or else the mean of the table.
    """
    features = list(scorer.features)
    learnt = getattr(getattr(scorer, "model", None), "prepared", None)
    if learnt is not None:
        by_name = dict(zip(learnt.features, learnt.means))
        means = [F.lit(float(by_name[f])) for f in features]
    else:
        row = df.agg(F.struct(*[F.avg(as_double(f)).alias(f"m{i}") for i, f in enumerate(features)])).scalar()
        means = [F.coalesce(row[f"m{i}"], F.lit(0.0)) for i in range(len(features))]
    values = [F.coalesce(as_double(f), m).alias(f) for f, m in zip(features, means)]
    return df.select(ref(id_col).alias("id"), F.monotonically_increasing_id().alias("_row"), *values)


def background(
    df: DataFrame, id_col: str, features: Sequence[str], n: int = BACKGROUND_ROWS, seed: int = 42
) -> list[list[float]]:
    """At most n sampled feature rows, as plain numbers; a missing value becomes the table's mean."""
    values = [as_double(f).alias(f"f{i}") for i, f in enumerate(features)]
    rows = hash_sample(df, id_col, n, seed).select(*values).collect()
    if not any(v is None for r in rows for v in r):
        return [list(r) for r in rows]
    means = df.agg(*[F.avg(as_double(f)).alias(f"m{i}") for i, f in enumerate(features)]).first()
    return [[(m or 0.0) if v is None else v for v, m in zip(r, means)] for r in rows]


def explained_rows(
    df: DataFrame, id_col: str, selection: DataFrame | None = None, n: int | None = None
) -> DataFrame:
    """The selected rows; without a selection the first n by id, or all rows if n is not given."""
    if selection is not None:
        return df.join(selection.select(ref(id_col)).distinct(), id_col, "left_semi")
    return df if n is None else df.orderBy(ref(id_col)).limit(n)


def coalition_weights(n_features: int) -> np.ndarray:
    """(features, 2^features): factor of each coalition's value in each feature's Shapley value."""
    m = n_features
    masks = np.arange(2**m)
    sizes = np.array([int(s).bit_count() for s in masks])
    out = np.zeros((m, 2**m))
    for i in range(m):
        inside = (masks >> i) & 1 == 1
        others = np.where(inside, sizes - 1, sizes)
        weight = np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in others])
        out[i] = np.where(inside, weight, -weight)
    return out


def _unfold(df: DataFrame, id_col: str, cells: Sequence[tuple[str, str, Column, Column]]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(c).alias("class"), F.lit(f).alias("feature"), phi.alias("phi"), value.alias("value")
        )
        for c, f, phi, value in cells
    ]
    return df.select(ref(id_col).alias("id"), F.inline(F.array(*rows)))


def linear_shap(df: DataFrame, id_col: str, scorer: LinearScorer) -> DataFrame:
    """Weight times distance from the mean, on the margin of the second class. No background needed."""
    means = df.agg(
        F.struct(*[F.avg(as_double(f)).alias(f"m{i}") for i, f in enumerate(scorer.features)])
    ).scalar()
    rows = df.withColumn("_m", means)
    cells = []
    for i, (f, w) in enumerate(zip(scorer.features, scorer.weights)):
        mean = F.col(f"_m.m{i}")
        value = F.coalesce(as_double(f), mean)
        cells.append((scorer.classes[1], f, F.lit(w) * (value - mean), value))
    return _unfold(rows, id_col, cells)


def linear_base(df: DataFrame, scorer: LinearScorer) -> DataFrame:
    """(class, base): the margin at the feature means."""
    means = [F.avg(as_double(f)) for f in scorer.features]
    return df.agg(scorer.margin(means).alias("base")).select(
        F.lit(scorer.classes[1]).alias("class"), "base"
    )


def _folded(scored: DataFrame, scorer: Scorer, weights: Sequence[Column]) -> DataFrame:
    """Attributions from scored mixes: per row and feature the weighted sum of the probabilities.

    Rows were spread by id, so this sum stays inside the partition; rows of one id are told apart by key.
    """
    features, classes = list(scorer.features), list(scorer.classes)
    m = len(features)
    shares = [w.alias(f"_w{i}") for i, w in enumerate(weights)]
    sums = (
        scored.select("id", "_row", "probability", *[f"_x{i}" for i in range(m)], *shares)
        .groupBy("id", "_row")
        .agg(
            *[F.expr(f"max(_x{i}) as _x{i}") for i in range(m)],
            *[
                F.expr(f"sum(_w{i} * probability[{c}]) as _phi_{c}_{i}")
                for c in range(len(classes))
                for i in range(m)
            ],
        )
    )
    cells = [
        (name, f, F.col(f"_phi_{c}_{i}"), F.col(f"_x{i}"))
        for c, name in enumerate(classes)
        for i, f in enumerate(features)
    ]
    return _unfold(sums, "id", cells)


def _points(df: DataFrame, id_col: str, scorer: Scorer) -> DataFrame:
    """(id, _row, _x0, _x1, ...) spread by id."""
    names = [f"_x{i}" for i in range(len(scorer.features))]
    rows = imputed(df, id_col, scorer)
    return spread(rows.select("id", "_row", *[ref(f).alias(x) for f, x in zip(scorer.features, names)]), "id")


def exact_shap(
    df: DataFrame, id_col: str, scorer: Scorer, rows: Sequence[Sequence[float]]
) -> DataFrame:
    """All 2^M coalitions of an expression model or a fitted pipeline; M <= 10.

    Rows are first spread by id. Each is then unfolded to its coalitions and background mixes, scored
    in one transform and summed up again inside its partition: the unfolded rows are never shuffled.
    """
    features = list(scorer.features)
    m = len(features)
    if m > MAX_EXACT:
        raise ValueError(f"exact attribution needs at most {MAX_EXACT} features; ask for method='sampled'")
    mixes = (
        _points(df, id_col, scorer)
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(2**m - 1))).alias("_mask"))
        .select("*", F.explode(literal_matrix(rows)).alias("_b"))
    )
    mixed = [
        F.expr(f"case when (_mask & {1 << i}) <> 0 then _x{i} else _b[{i}] end").alias(f)
        for i, f in enumerate(features)
    ]
    mixes = mixes.select("id", "_row", "_mask", *[f"_x{i}" for i in range(m)], *mixed)
    weights = coalition_weights(m) / len(rows)
    shares = [F.get(literal_vector(weights[i]), F.col("_mask")) for i in range(m)]
    return _folded(scorer.transform(mixes), scorer, shares)


def _orders(n_features: int, rows: Sequence[Sequence[float]], n: int, seed: int):
    """n fixed draws of a feature order and a background row."""
    rng = np.random.RandomState(seed)
    ranks = np.array([rng.permutation(n_features) for _ in range(n)])
    drawn = np.asarray(rows, dtype=float)[np.arange(n) % len(rows)]
    return ranks, drawn


def sampled_shap(
    df: DataFrame,
    id_col: str,
    scorer: Scorer,
    rows: Sequence[Sequence[float]],
    n_orders: int = 200,
    seed: int = 42,
) -> DataFrame:
    """Permutation sampling (Strumbelj and Kononenko, 2014), for any number of features.

    Each draw walks from a background row to the explained row in a random feature order; the steps
    of a draw add up to the difference of the two predictions, so sums are exact. Expression models
    are walked inside array functions; other models score every step as a row, like `exact_shap`.
    """
    features, classes = list(scorer.features), list(scorer.classes)
    m = len(features)
    ranks, drawn = _orders(m, rows, n_orders, seed)
    draws = literal_matrix(np.concatenate([ranks, drawn], axis=1))
    points = _points(df, id_col, scorer)
    x = [F.col(f"_x{i}") for i in range(m)]
    if not isinstance(scorer, ExprScorer):
        steps = points.select("*", F.explode(draws).alias("_d")).select(
            "*", F.explode(F.sequence(F.lit(0), F.lit(m))).alias("_step")
        )
        mixed = [
            F.when(F.col("_d")[i] < F.col("_step"), x[i]).otherwise(F.col("_d")[m + i]).alias(f)
            for i, f in enumerate(features)
        ]
        kept = ["id", "_row", "_step", *[f"_x{i}" for i in range(m)]]
        rows_ = steps.select(*kept, F.slice("_d", 1, m).alias("_ranks"), *mixed)
        # a feature's gain is the score after its step less the score before it
        shares = [
            (
                (F.col("_ranks")[i] == F.col("_step") - 1).cast("double")
                - (F.col("_ranks")[i] == F.col("_step")).cast("double")
            )
            / F.lit(float(n_orders))
            for i in range(m)
        ]
        return _folded(scorer.transform(rows_), scorer, shares)

    def step(i: int, c: int) -> Column:
        def gain(d: Column) -> Column:
            def at(own: bool) -> Column:
                values = []
                for j in range(m):
                    if j == i:
                        values.append(x[j] if own else d[m + j])
                    else:
                        values.append(F.when(d[j] < d[i], x[j]).otherwise(d[m + j]))
                return scorer.probability(values)[c]

            return at(True) - at(False)

        total = F.aggregate(F.col("_draws"), F.lit(0.0), lambda s, d: s + gain(d))
        return total / F.lit(float(n_orders))

    cells = [(name, f, step(i, c), x[i]) for c, name in enumerate(classes) for i, f in enumerate(features)]
    return _unfold(points.withColumn("_draws", draws), "id", cells)


def batch_shap(
    df: DataFrame,
    id_col: str,
    scorer: BatchScorer,
    rows: Sequence[Sequence[float]],
    n_orders: int = 200,
    seed: int = 42,
    method: str = "exact",
    chunk: int = 16,
) -> DataFrame:
    """The same values for a model given as a matrix function, called for `chunk` rows at a time."""
    features, classes, fn = list(scorer.features), list(scorer.classes), scorer.fn
    m, bg, n_classes = len(features), np.asarray(rows, dtype=float), len(classes)
    exact = method == "exact"
    if exact and m > MAX_EXACT:
        raise ValueError(f"exact attribution needs at most {MAX_EXACT} features; ask for method='sampled'")
    if exact:
        inside = (np.arange(2**m)[:, None] >> np.arange(m)[None, :]) & 1 == 1
        weights = coalition_weights(m)
    else:
        ranks, drawn = _orders(m, rows, n_orders, seed)
        places = np.argsort(ranks, axis=1)  # feature taken at each step

    def attribute(points: np.ndarray) -> np.ndarray:
        """(rows, features, classes) of a chunk, by one call of the model."""
        if exact:
            mixed = np.where(inside[None, :, None, :], points[:, None, None, :], bg[None, None, :, :])
            values = np.asarray(fn(mixed.reshape(-1, m)), dtype=float)
            means = values.reshape(len(points), 2**m, len(bg), n_classes).mean(2)
            return np.einsum("fk,rkc->rfc", weights, means)
        before = ranks[None, :, None, :] < np.arange(m + 1)[None, None, :, None]
        mixed = np.where(before, points[:, None, None, :], drawn[None, :, None, :])
        values = np.asarray(fn(mixed.reshape(-1, m)), dtype=float).reshape(len(points), len(ranks), m + 1, n_classes)
        gains = np.diff(values, axis=2)
        by_feature = np.take_along_axis(gains, np.argsort(places, axis=1)[None, :, :, None], axis=2)
        return by_feature.mean(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), chunk):
                part = batch.iloc[at : at + chunk]
                points = np.stack(part["x"].to_numpy()).astype(float)
                phi = attribute(points).transpose(0, 2, 1)  # rows, classes, features
                yield pd.DataFrame(
                    {
                        "id": np.repeat(part["id"].to_numpy(), n_classes * m),
                        "class": np.tile(np.repeat(classes, m), len(part)),
                        "feature": np.tile(features, len(part) * n_classes),
                        "phi": phi.ravel(),
                        "value": np.repeat(points, n_classes, axis=0).ravel(),
                    }
                )

    ready = imputed(df, id_col, scorer).select("id", F.array(*[ref(f) for f in features]).alias("x"))
    kind = ready.schema["id"].dataType.simpleString()
    schema = f"id {kind}, class string, feature string, phi double, value double"
    return spread(ready, "id").mapInPandas(run, schema)


def shap_values(
    df: DataFrame,
    id_col: str,
    scorer: Scorer,
    rows: Sequence[Sequence[float]] | None = None,
    method: str | None = None,
    **options,
) -> DataFrame:
    """Attributions by the method asked for: linear, tree, exact (at most 10 features) or sampled.

    Without one: linear for a linear scorer without a background, tree for a trained forest (of any number of features), else exact,
    which raises beyond 10 features. Boosted trees are explained on their margins if `tree` is asked for.
    """
    if method is None:
        forest = type(fitted_trees(scorer)).__name__ == "RandomForestClassificationModel"
        method = "linear" if isinstance(scorer, LinearScorer) and rows is None else "tree" if forest else "exact"
    if method not in ("linear", "tree", "exact", "sampled"):
        raise ValueError(f"Unknown method: {method}")
    if method == "linear":
        return linear_shap(df, id_col, scorer)
    rows = rows if rows is not None else background(df, id_col, scorer.features)
    if method == "tree":
        return tree_shap(df, id_col, scorer, rows)
    if isinstance(scorer, BatchScorer):
        return batch_shap(df, id_col, scorer, rows, method=method, **options)
    if method == "sampled":
        return sampled_shap(df, id_col, scorer, rows, **options)
    return exact_shap(df, id_col, scorer, rows)


def base_values(scorer: Scorer, spark, rows: Sequence[Sequence[float]]) -> DataFrame:
    """(class, base): the mean probability over the background."""
    frame = spark.createDataFrame(rows, ", ".join(f"`{f}` double" for f in scorer.features))
    names = F.array(*[F.lit(c) for c in scorer.classes])
    return (
        scorer.transform(frame)
        .select(F.posexplode("probability").alias("i", "p"))
        .groupBy(F.get(names, F.col("i")).alias("class"))
        .agg(F.avg("p").alias("base"))
    )


def reduce_classes(long: DataFrame, how: str = "mean", first: str | None = None) -> DataFrame:
    """One value per (id, feature): the signed mean over classes, or the class named `first`."""
    if how == "first":
        return long.where(F.col("class") == first).drop("class")
    if how != "mean":
        raise ValueError(f"Unknown reduction: {how}")
    return long.groupBy("id", "feature").agg(F.avg("phi").alias("phi"), F.max("value").alias("value"))


def importance(long: DataFrame, top: int | None = None) -> DataFrame:
    """(feature, mean_abs_phi), the largest first; all features unless `top` is given."""
    ranked = (
        long.groupBy("feature")
        .agg(F.round(F.avg(F.abs("phi")), 6).alias("mean_abs_phi"))
        .orderBy(F.desc("mean_abs_phi"), "feature")
    )
    return ranked if top is None else ranked.limit(top)


def waterfall(long: DataFrame, top: int | None = None, base: DataFrame | None = None) -> DataFrame:
    """(id, rank, feature, phi, sign, base): the strongest features of every row, all unless `top` is given.

    `base` is the one-row (or, with classes, per-class) table of `base_values`; without it the column is null.
    """
    order = Window.partitionBy("id").orderBy(F.desc(F.abs("phi")), "feature")
    ranked = long.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    if base is None:
        ranked = ranked.withColumn("base", F.lit(None).cast("double"))
    elif "class" in long.columns:
        ranked = ranked.join(base.select("class", "base"), "class")
    else:
        ranked = ranked.withColumn("base", base.select("base").scalar())
    sign = F.when(F.col("phi") > 0, "positive").otherwise("negative").alias("sign")
    return ranked.select("id", "rank", "feature", "phi", sign, "base")


def distribution(long: DataFrame, top: int | None = None, min_rows: int = 1) -> DataFrame:
    """(id, feature, rank, phi, normalised, value) of all features, or of the `top` strongest ones."""
    stats = long.groupBy("feature").agg(
        F.avg(F.abs("phi")).alias("strength"),
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
    )
    # one row per feature
    ranked = stats.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("strength"), "feature")) - 1
    ).where(F.col("n") >= min_rows)
    if top is not None:
        ranked = ranked.where(F.col("rank") < top)
    ranked = ranked.select("feature", "rank", "lo", "hi")
    scaled = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-10)
    return long.join(F.broadcast(ranked), "feature").select(
        "id",
        "feature",
        "rank",
        "phi",
        scaled.alias("normalised"),
        "value",
    )


def dependence(long: DataFrame, feature: str, interaction: str | None = None) -> DataFrame:
    """(id, value, phi) of one feature, with the value of another one as `interaction`."""
    own = long.where(F.col("feature") == feature).select("id", "value", "phi")
    if interaction is None or interaction == feature:
        return own
    other = long.where(F.col("feature") == interaction).select(
        "id", F.col("value").alias("interaction")
    )
    return own.join(other, "id")


def append_shap(df: DataFrame, id_col: str, long: DataFrame | None, features: Sequence[str]) -> DataFrame:
    """Append `shap_<feature>` columns; without attributions the table is returned unchanged."""
    if long is None:
        return df
    wide = long.groupBy(F.col("id").alias(id_col)).agg(
        *[F.max(F.when(F.col("feature") == f, F.col("phi"))).alias(f"shap_{f}") for f in features]
    )
    return df.join(wide, id_col, "left")
