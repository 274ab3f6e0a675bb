"""Distribution drift between a reference and a production table, and over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mldiag.functions.columns import kolmogorov_pvalue, numeric_columns, ref
from mldiag.operators.scale import (
    assign_windows,
    global_cumsum,
    rank_picks,
    unpivot_features,
    window_starts,
)

PSI_FLOOR = 0.000001
N_WINDOWS = 20


def drift_features(
    reference: DataFrame,
    production: DataFrame,
    features: Sequence[str] | None = None,
    timestamp_col: str | None = None,
) -> list[str]:
    """Features present on both sides; by default the numeric reference columns but the time column."""
    wanted = features or [c for c in numeric_columns(reference) if c != timestamp_col]
    return [f for f in wanted if f in reference.columns and f in production.columns]


def stack_sides(
    reference: DataFrame, production: DataFrame, features: Sequence[str]
) -> DataFrame:
    """Both tables long, with `n_ref` / `n_prod` marking the side each value came from."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    ref_long = unpivot_features(reference, features).select(
        "feature", "value", one.alias("n_ref"), zero.alias("n_prod")
    )
    prod_long = unpivot_features(production, features).select(
        "feature", "value", zero.alias("n_ref"), one.alias("n_prod")
    )
    return ref_long.unionByName(prod_long)


def side_counts(sided: DataFrame) -> DataFrame:
    """Distinct (feature, value) with their counts on both sides; hot values collapse map-side."""
    return sided.groupBy("feature", "value").agg(
        F.sum("n_ref").alias("n_ref"), F.sum("n_prod").alias("n_prod")
    )


def bin_of(value: Column, edges: Column) -> Column:
    """Bin number of a value: how many of the sorted interior edges are at or below it."""
    return F.size(F.filter(edges, lambda e: e <= value))


def psi_from_counts(binned: DataFrame, n_bins: int, keys: Sequence[str]) -> DataFrame:
    """Population stability index of (keys, bin, n_ref, n_prod); `keys` include both totals.

    A bin that is empty on both sides adds nothing, so merged bins need no special care.
    """
    sums, terms = [], []
    for b in range(n_bins):
        for side in ("ref", "prod"):
            sums.append(F.expr(f"sum(case when bin = {b} then n_{side} else 0 end) as _{side}_{b}"))
        terms.append(psi_term(f"_prod_{b} / total_prod", f"_ref_{b} / total_ref"))
    index = f"greatest(0.0D, {' + '.join(terms)})"
    return binned.groupBy(*keys).agg(*sums).select(*keys, F.expr(index).alias("psi_raw"))


def psi_term(production_share: str, reference_share: str) -> str:
    """SQL for one bin's part of the index; shares are floored at 1e-6."""
    p = f"greatest({production_share}, {PSI_FLOOR}D)"
    r = f"greatest({reference_share}, {PSI_FLOOR}D)"
    return f"({p} - {r}) * ln({p} / {r})"


def drift_scores(
    reference: DataFrame,
    production: DataFrame,
    features: Sequence[str] | None = None,
    timestamp_col: str | None = None,
    n_bins: int = 10,
) -> DataFrame:
    """(feature, ks_statistic, ks_pvalue, psi, drift) for every feature with values on both sides.

    One pass: values are collapsed to counts, ordered once by a distributed running sum, and both
    the KS statistic and the reference percentiles for the PSI bins are read off that table.
    """
    names = drift_features(reference, production, features, timestamp_col)
    counts = side_counts(stack_sides(reference, production, names))
    return scores_from_counts(counts, n_bins)


def scores_from_counts(counts: DataFrame, n_bins: int = 10) -> DataFrame:
    running = global_cumsum(counts, ["feature"], "value", ["n_ref", "n_prod"])
    total_ref, total_prod = F.col("total_n_ref"), F.col("total_n_prod")
    gap = F.abs(
        F.col("cum_n_ref").cast("double") * total_prod
        - F.col("cum_n_prod").cast("double") * total_ref
    ) / (total_ref.cast("double") * total_prod)
    picked = psi_edges(
        running.where((total_ref > 0) & (total_prod > 0)),
        n_bins,
        extra=[
            F.max(gap).alias("ks"),
            F.max(total_ref).alias("total_ref"),
            F.max(total_prod).alias("total_prod"),
        ],
    )
    # one row per feature with at most n_bins - 1 edges
    binned = counts.join(F.broadcast(picked), "feature").withColumn(
        "bin", bin_of(F.col("value"), F.col("edges"))
    )
    scored = psi_from_counts(binned, n_bins, ("feature", "ks", "total_ref", "total_prod"))
    pvalue = kolmogorov_pvalue(F.col("ks"), F.col("total_ref"), F.col("total_prod"))
    return scored.withColumn("p_raw", pvalue).select(
        "feature",
        F.round("ks", 4).alias("ks_statistic"),
        F.round("p_raw", 4).alias("ks_pvalue"),
        F.round("psi_raw", 4).alias("psi"),
        F.when(F.col("p_raw") < 0.05, "Yes").otherwise("No").alias("drift"),
    )


def psi_edges(
    running: DataFrame, n_bins: int = 10, weight: str = "n_ref", extra: Sequence[Column] = ()
) -> DataFrame:
    """(feature, edges, extra...): distinct interior percentiles of the reference values."""
    interior = [i / n_bins for i in range(1, n_bins)]
    picked = rank_picks(running, "feature", weight, interior, extra)
    return picked.withColumn("edges", F.array_sort(F.array_distinct("quantiles"))).drop("quantiles")


def reference_bins(reference: DataFrame, features: Sequence[str], n_bins: int = 10) -> DataFrame:
    """(feature, edges, bin, share): the fixed bins a later batch or stream is compared with."""
    counts = unpivot_features(reference, features).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n_ref")
    )
    edges = psi_edges(global_cumsum(counts, ["feature"], "value", ["n_ref"]), n_bins)
    filled = (
        counts.join(F.broadcast(edges), "feature")
        .withColumn("bin", bin_of(F.col("value"), F.col("edges")))
        .groupBy("feature", "bin")
        .agg(F.sum("n_ref").alias("n_ref"))
    )
    every = edges.select(
        "feature", "edges", "total", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin")
    )
    return every.join(filled, ["feature", "bin"], "left").select(
        "feature",
        "edges",
        "bin",
        (F.coalesce("n_ref", F.lit(0)) / F.col("total")).alias("share"),
    )


def time_windows(
    production: DataFrame, timestamp_col: str, id_col: str, max_windows: int = N_WINDOWS
) -> DataFrame:
    """Equal-count consecutive windows by time: min(max_windows, n // 10) of them, no rows below two."""
    n_windows = 0

    def starts(total: int) -> list[int]:
        nonlocal n_windows
        n_windows = min(max_windows, total // 10)
        return window_starts(total, n_windows)

    windowed = assign_windows(production, timestamp_col, id_col, starts)
    timed = windowed.where(ref(timestamp_col).isNotNull())
    return timed if n_windows >= 2 else timed.limit(0)


def reference_counts(reference: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value, n_ref): the reference as counts, to be stored where many windows are held against it."""
    return unpivot_features(reference, features).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n_ref"))


def ks_by_group(ref_counts: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, feature, n, ks): each group of (keys, feature, value, n) against (feature, value, n_ref); groups need two rows.

    The reference is ordered once for all groups. The largest gap to a group's step function lies at one of its values or just before
    it, so groups only carry their own values, whether the reference has them or not.
    """
    points = (
        ref_counts.unionByName(counts.select("feature", "value", F.lit(0).cast("bigint").alias("n_ref")))
        .groupBy("feature", "value")
        .agg(F.sum("n_ref").alias("n_ref"))
    )
    ref_running = global_cumsum(points, ["feature"], "value", ["n_ref"])
    running = global_cumsum(counts, [*keys, "feature"], "value", ["n"])
    both = running.where(F.col("total_n") > 1).join(ref_running, ["feature", "value"])
    at = F.abs(F.col("cum_n_ref") / F.col("total_n_ref") - F.col("cum_n") / F.col("total_n"))
    below = F.abs(
        (F.col("cum_n_ref") - F.col("n_ref")) / F.col("total_n_ref")
        - (F.col("cum_n") - F.col("n")) / F.col("total_n")
    )
    return both.groupBy(*keys, "feature").agg(F.max("total_n").alias("n"), F.max(F.greatest(at, below)).alias("ks"))


def temporal_drift(
    reference: DataFrame,
    production: DataFrame,
    timestamp_col: str,
    id_col: str,
    features: Sequence[str] | None = None,
    max_windows: int = N_WINDOWS,
) -> DataFrame:
    """(window, mean_ks, max_ks): each time window of production against the whole reference."""
    names = drift_features(reference, production, features, timestamp_col)
    ref_counts = reference_counts(reference, names)
    windowed = time_windows(production, timestamp_col, id_col, max_windows)
    win_counts = (
        unpivot_features(windowed, names, keep=["window"])
        .groupBy("window", "feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_feature = ks_by_group(ref_counts, win_counts, ["window"])
    return per_feature.groupBy("window").agg(
        F.round(F.avg("ks"), 4).alias("mean_ks"), F.round(F.max("ks"), 4).alias("max_ks")
    )


def half_split(df: DataFrame, order_col: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """First floor(n/2) rows by (order, id) as reference, the rest as production."""

    halves = assign_windows(df, order_col, id_col, lambda total: [total // 2], name="_half")
    return (
        halves.where(F.col("_half") == 0).drop("_half"),
        halves.where(F.col("_half") == 1).drop("_half"),
    )


def density_curves(
    long: DataFrame, n_bins: int = 1024, n_grid: int = 100, keys: Sequence[str] = ("feature", "side")
) -> DataFrame:
    """Gaussian density per (keys) on a grid over the group's range, Scott's bandwidth.

    Values are first counted in `n_bins` equal bins of the group's range, so the kernel sum costs
    bins x grid points per group whatever the row count. Groups need two distinct values.
    """
    keys = list(keys)
    spread = (
        long.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.stddev_samp("value").alias("sd"),
            F.min("value").alias("lo"),
            F.max("value").alias("hi"),
        )
        .where((F.col("total") > 1) & (F.col("hi") > F.col("lo")))
        .withColumn("h", F.col("sd") * F.pow(F.col("total").cast("double"), F.lit(-0.2)))
        .withColumn("w", (F.col("hi") - F.col("lo")) / n_bins)
    )
    binned = (
        long.join(F.broadcast(spread), keys)
        .withColumn(
            "bin",
            F.least(F.lit(n_bins - 1), F.floor((F.col("value") - F.col("lo")) / F.col("w"))),
        )
        .groupBy(*keys, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.max(c).alias(c) for c in ("total", "lo", "hi", "h", "w")],
        )
    )
    step = (F.col("hi") - F.col("lo")) / (n_grid - 1)
    at_grid = binned.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))).alias("grid")
    ).withColumn("x", F.col("lo") + F.col("grid") * step)
    center = F.col("lo") + (F.col("bin") + 0.5) * F.col("w")
    z = (F.col("x") - center) / F.col("h")
    return (
        at_grid.groupBy(*keys, "grid")
        .agg(
            F.max("x").alias("x"),
            (
                F.sum(F.col("n") * F.exp(-0.5 * z * z))
                / F.max(F.col("total") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi()))
            ).alias("density"),
        )
        .select(*keys, "grid", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))
    )


def side_densities(
    reference: DataFrame, production: DataFrame, features: Sequence[str], **grid
) -> DataFrame:
    """Density curves of each feature on the reference and the production side."""
    long = (
        unpivot_features(reference, features)
        .withColumn("side", F.lit("reference"))
        .unionByName(
            unpivot_features(production, features).withColumn("side", F.lit("production"))
        )
    )
    return density_curves(long, **grid)


def split_at(df: DataFrame, column: str, boundary: Column) -> tuple[DataFrame, DataFrame]:
    """Rows before a boundary value and rows at or after it."""
    return df.where(ref(column) < boundary), df.where(ref(column) >= boundary)
