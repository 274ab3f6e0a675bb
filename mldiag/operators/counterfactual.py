"""Smallest single-feature changes that flip a prediction, and what-if comparisons."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mldiag.functions.columns import as_double, ref
from mldiag.operators.scale import spread
from mldiag.operators.scoring import Scorer

STEPS = 50
DIRECTIONS = ("max", "min")


def _spans(df: DataFrame, features, population: DataFrame) -> DataFrame:
    """Append `_s` with min and max of each feature over the whole population."""
    stats = population.agg(
        F.struct(
            *[fn(as_double(f)).alias(f"{name}{i}") for i, f in enumerate(features) for fn, name in ((F.min, "lo"), (F.max, "hi"))]
        )
    ).scalar()
    return df.withColumn("_s", stats)


def _end(i: int, value: Column, direction: str) -> Column:
    """End of the searched range: the population's extent +- 10 %, or the own value +- 1.2 when the
    feature is constant."""
    lo, hi = F.col(f"_s.lo{i}"), F.col(f"_s.hi{i}")
    lo, hi = F.when(lo == hi, value - 1.0).otherwise(lo), F.when(lo == hi, value + 1.0).otherwise(hi)
    margin = (hi - lo) * 0.1
    return hi + margin if direction == "max" else lo - margin


def sweep(
    df: DataFrame, id_col: str, scorer: Scorer, population: DataFrame | None = None, n_steps: int = STEPS
) -> DataFrame:
    """(id, feature, feature_pos, direction, original, flip_value, change) where a flip exists.

    Every feature is moved alone over `n_steps` evenly spaced values towards each end of its range;
    the first value (the nearest one) with another prediction is kept. Rows are spread by id, then
    unfolded to their grid, scored in one transform and folded again inside their partition. Ids are
    unique.
    """
    features = list(scorer.features)
    m = len(features)
    points = _spans(df, features, population if population is not None else df).select(
        ref(id_col).alias("id"), *[as_double(f).alias(f) for f in features], "_s"
    )
    own = scorer.transform(spread(points, "id")).withColumnsRenamed({"prediction": "_own"})
    x = [ref(f) for f in features]
    moves = F.array(
        *[
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(direction).alias("direction"),
                ((_end(i, x[i], direction) - x[i]) / (n_steps - 1)).alias("width"),
            )
            for i in range(m)
            for direction in DIRECTIONS
        ]
    )
    grid = (
        own.select("id", "_own", *[x[i].alias(f"_x{i}") for i in range(m)], F.inline(moves))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))).alias("_t"))
        .select(
            "*",
            *[
                F.expr(f"case when pos = {i} then _x{i} + _t * width else _x{i} end").alias(f)
                for i, f in enumerate(features)
            ],
        )
    )
    flipped = scorer.transform(grid).where(F.col("prediction") != F.col("_own"))
    original = F.get(F.array(*[F.col(f"_x{i}") for i in range(m)]), F.col("pos"))
    value = F.get(F.array(*x), F.col("pos"))
    first = F.min(F.struct(F.col("_t"), value.alias("flip"), original.alias("original")))
    names = F.array(*[F.lit(f) for f in features])
    return (
        flipped.groupBy("id", "pos", "direction")
        .agg(first.alias("b"))
        .select(
            "id",
            F.get(names, F.col("pos")).alias("feature"),
            F.col("pos").alias("feature_pos"),
            "direction",
            F.col("b.original").alias("original"),
            F.col("b.flip").alias("flip_value"),
            F.abs(F.col("b.flip") - F.col("b.original")).alias("change"),
        )
    )


def minimum_flip(
    df: DataFrame, id_col: str, scorer: Scorer, population: DataFrame | None = None, n_steps: int = STEPS
) -> DataFrame:
    """(id, feature, direction, original, flip_value, change): the smallest change per row.

    Ties go to the earlier feature, then to the move upwards. Rows that cannot be flipped are absent.
    """
    found = sweep(df, id_col, scorer, population, n_steps)
    best = F.min(
        F.struct(
            F.round("change", 9).alias("change"),
            "feature_pos",
            (F.col("direction") == "min").alias("down"),
            "feature",
            "direction",
            "original",
            "flip_value",
        )
    )
    return found.groupBy("id").agg(best.alias("b")).select(
        "id",
        F.col("b.feature").alias("feature"),
        F.col("b.direction").alias("direction"),
        F.round("b.original", 6).alias("original"),
        F.round("b.flip_value", 6).alias("flip_value"),
        F.round("b.change", 6).alias("change"),
    )


def what_if(
    df: DataFrame, id_col: str, scorer: Scorer, changes: Mapping[str, Column]
) -> DataFrame:
    """(id, class, original, modified, delta, flipped, changed): each class before and after changes.

    `changed` lists the features that moved by more than 1e-6.
    """
    before = scorer.transform(df.drop("prediction", "probability"))
    kept = [ref(f) for f in scorer.features]
    before = before.select(
        ref(id_col).alias("id"),
        *[k.cast("double").alias(f"_x{i}") for i, k in enumerate(kept)],
        F.col("probability").alias("_p0"),
        F.col("prediction").alias("_own"),
        *kept,
    )
    modified = before.withColumns({f: c.cast("double") for f, c in changes.items()})
    after = scorer.transform(modified)
    moved = [
        F.when(F.abs(ref(f).cast("double") - F.col(f"_x{i}")) > 1e-6, F.lit(f))
        for i, f in enumerate(scorer.features)
    ]
    names = F.array(*[F.lit(c) for c in scorer.classes])
    pairs = F.posexplode(F.arrays_zip(F.col("_p0").alias("o"), F.col("probability").alias("m")))
    return (
        after.select(
            "id",
            (F.col("prediction") != F.col("_own")).alias("flipped"),
            F.array_join(F.array_compact(F.array(*moved)), ",").alias("changed"),
            pairs.alias("_i", "_z"),
        )
        .select(
            "id",
            F.get(names, F.col("_i")).alias("class"),
            F.round("_z.o", 6).alias("original"),
            F.round("_z.m", 6).alias("modified"),
            F.round(F.col("_z.m") - F.col("_z.o"), 6).alias("delta"),
            "flipped",
            "changed",
        )
    )
