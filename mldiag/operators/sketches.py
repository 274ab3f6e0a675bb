"""Mergeable state of growing tables: quantile sketches (KLL) and distinct sketches (theta) by period and column.

A state table has a row per (period, feature), a few kilobytes each. New periods are appended; quartiles, bin edges and distinct counts of any
span come from merging its rows, without reading the table again. Values combine map-side, so a value or period that holds a third
of all rows is no hot key. Up to about `k` values a quantile state is exact; beyond, the rank of an answer is off by 1.7 / k^0.9 or so of the
rows at most (with high probability), whatever the number of merges. A distinct state is exact up to 2^`lg` values and off by 2 / sqrt(2^lg) beyond.

Cases: missing values are left out; a period without any value of a feature has no row; a null period is a period of its own; an
empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mldiag.functions.columns import ref
from mldiag.operators.scale import unpivot_features

QUANTILE_K = 1024
DISTINCT_LG = 12


def quantile_state(df: DataFrame, features: Sequence[str], period: Column, k: int = QUANTILE_K) -> DataFrame:
    """(period, feature, n, state): a KLL sketch of each numeric feature in each period."""
    long = unpivot_features(df.withColumn("_period", period), features, ["_period"])
    state = F.kll_sketch_agg_double("value", F.lit(k)).alias("state")
    return long.groupBy(F.col("_period").alias("period"), "feature").agg(F.count(F.lit(1)).alias("n"), state)


def merged_quantiles(state: DataFrame, by: Sequence[str] = ("feature",), k: int = QUANTILE_K) -> DataFrame:
    """The states of all periods in `state`, merged by the given columns: (by..., n, state)."""
    return state.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("state", F.lit(k)).alias("state"))


def quantiles_of(state: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """`state` with `quantiles`: for each probability the smallest value whose share of values up to it reaches it."""
    values = [F.kll_sketch_get_quantile_double("state", F.lit(float(p))) for p in probabilities]
    return state.withColumn("quantiles", F.array(*values)).drop("state")


def outlier_bounds(state: DataFrame, factor: float = 1.5) -> DataFrame:
    """(..., q1, median, q3, lower, upper) of merged states, for the IQR rule."""
    found = quantiles_of(state, [0.25, 0.5, 0.75])
    q1, q2, q3 = (F.get("quantiles", F.lit(i)) for i in range(3))
    spread = (q3 - q1) * factor
    return found.select("*", q1.alias("q1"), q2.alias("median"), q3.alias("q3"), (q1 - spread).alias("lower"), (q3 + spread).alias("upper")).drop("quantiles")


def bin_edges(state: DataFrame, n_bins: int = 10) -> DataFrame:
    """(feature, edges): distinct inner edges of equal-count bins, as the PSI of a growing reference needs them."""
    found = quantiles_of(state, [i / n_bins for i in range(1, n_bins)])
    return found.select("feature", F.array_sort(F.array_distinct("quantiles")).alias("edges"))


def distinct_state(df: DataFrame, columns: Sequence[str], period: Column, lg: int = DISTINCT_LG) -> DataFrame:
    """(period, feature, state): a theta sketch of the values of each column in each period."""
    cast = df.select(period.alias("period"), *[ref(c).cast("string").alias(c) for c in columns])
    long = cast.unpivot(["period"], [ref(c) for c in columns], "feature", "value").where(F.col("value").isNotNull())
    return long.groupBy("period", "feature").agg(F.theta_sketch_agg("value", F.lit(lg)).alias("state"))


def distinct_counts(state: DataFrame, by: Sequence[str] = ("feature",), lg: int = DISTINCT_LG) -> DataFrame:
    """(by..., n_distinct) over all periods of `state`."""
    union = F.theta_union_agg("state", F.lit(lg))
    return state.groupBy(*by).agg(F.theta_sketch_estimate(union).alias("n_distinct"))


def distinct_change(reference: DataFrame, production: DataFrame, lg: int = DISTINCT_LG) -> DataFrame:
    """(feature, n_reference, n_production, n_both, n_new, n_vanished): values of two spans of states."""
    sides = []
    for name, state in (("r", reference), ("p", production)):
        sides.append(state.groupBy("feature").agg(F.theta_union_agg("state", F.lit(lg)).alias(name)))
    both = sides[0].join(sides[1], "feature", "full")  # a row a feature
    none = F.lit(0).cast("bigint")
    estimate = lambda c: F.coalesce(F.theta_sketch_estimate(c).cast("bigint"), none)
    r, p = F.col("r"), F.col("p")
    return both.select(
        "feature",
        estimate(r).alias("n_reference"),
        estimate(p).alias("n_production"),
        estimate(F.theta_intersection(r, p)).alias("n_both"),
        F.coalesce(estimate(F.when(r.isNull(), p).otherwise(F.theta_difference(p, r))), none).alias("n_new"),
        F.coalesce(estimate(F.when(p.isNull(), r).otherwise(F.theta_difference(r, p))), none).alias("n_vanished"),
    )
