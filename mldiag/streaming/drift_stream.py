"""Temporal drift on a stream: production counts per time window against fixed reference bins.

State holds one counter per (window, feature, bin) or (window, label) only; for Kolmogorov-Smirnov distances one per (window,
feature, distinct value), hashed over all state partitions. Rows later than the watermark are dropped. The reference bins or
counts are a table fixed before the stream starts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mldiag.functions.columns import as_double, kolmogorov_pvalue, literal_vector, ref
from mldiag.operators.drift import bin_of, ks_by_group, psi_term


def _window(time_col: str, size: str, slide: str | None) -> Column:
    return F.window(F.col(time_col), size, slide) if slide else F.window(F.col(time_col), size)


def with_event_time(stream: DataFrame, time_col: str, watermark: str) -> DataFrame:
    """Event time as TIMESTAMP (zone-free times cannot carry a watermark), with the watermark set."""
    return stream.withColumn(time_col, ref(time_col).cast("timestamp")).withWatermark(time_col, watermark)


def bin_counts(
    stream: DataFrame,
    time_col: str,
    edges: dict[str, Sequence[float]],
    size: str = "1 day",
    slide: str | None = None,
    watermark: str = "1 hour",
) -> DataFrame:
    """(start, feature, bin, n): tumbling or sliding window counts per reference bin."""
    timed = with_event_time(stream, time_col, watermark)
    cells = []
    for feature, cuts in edges.items():
        value = as_double(feature)
        number = bin_of(value, literal_vector(cuts)) if cuts else F.lit(0)
        cells.append(
            F.struct(F.lit(feature).alias("feature"), F.when(value.isNotNull(), number).alias("bin"))
        )
    long = timed.select(F.col(time_col), F.inline(F.array(*cells))).where(F.col("bin").isNotNull())
    return (
        long.groupBy(_window(time_col, size, slide).alias("w"), "feature", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), "feature", "bin", "n")
    )


def window_psi(counts: DataFrame, bins: DataFrame) -> DataFrame:
    """(start, feature, n, psi) from closed window counts and the reference (feature, bin, share).

    Runs on the sink's table or inside foreachBatch.
    """
    shares = bins.groupBy("feature").agg(
        F.sort_array(F.collect_list(F.struct("bin", "share"))).alias("_ref")
    )
    cells = counts.groupBy("start", "feature").agg(
        F.sum("n").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_n"),
    )
    term = psi_term("coalesce(_n[b.bin], 0) / total", "b.share")
    index = f"aggregate(_ref, 0.0D, (s, b) -> s + {term})"
    # a handful of bins per feature
    return cells.join(F.broadcast(shares), "feature").select(
        "start",
        "feature",
        F.col("total").alias("n"),
        F.round(F.greatest(F.lit(0.0), F.expr(index)), 4).alias("psi"),
    )


def value_counts(
    stream: DataFrame,
    time_col: str,
    features: Sequence[str],
    size: str = "1 day",
    slide: str | None = None,
    watermark: str = "1 hour",
) -> DataFrame:
    """(start, feature, value, n): each window's distinct values with their counts, emitted once, when the window closes.

    Exact distances need every distinct value of an open window, as many as its rows for a continuous feature: keep such state in
    the RocksDB store. Null and NaN values are left out.
    """
    timed = with_event_time(stream, time_col, watermark)
    cells = [F.struct(F.lit(f).alias("feature"), as_double(f).alias("value")) for f in features]
    long = timed.select(F.col(time_col), F.inline(F.array(*cells))).where(F.col("value").isNotNull())
    return (
        long.groupBy(_window(time_col, size, slide).alias("w"), "feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), "feature", "value", "n")
    )


def window_ks(counts: DataFrame, ref_counts: DataFrame) -> DataFrame:
    """(start, feature, n, ks_statistic, ks_pvalue, drift) of closed windows' value counts against `drift.reference_counts`.

    Runs on the sink's table or inside foreachBatch. Windows of one row, and features that the reference lacks, have no distance.
    """
    total = ref_counts.groupBy("feature").agg(F.sum("n_ref").alias("_total"))
    found = ks_by_group(ref_counts, counts, ["start"])
    p = kolmogorov_pvalue(F.col("ks"), F.col("_total"), F.col("n"))
    # one row per feature
    return found.join(F.broadcast(total), "feature").select(
        "start",
        "feature",
        "n",
        F.round("ks", 4).alias("ks_statistic"),
        F.round(p, 4).alias("ks_pvalue"),
        F.when(p < 0.05, "Yes").otherwise("No").alias("drift"),
    )


def class_counts(
    stream: DataFrame,
    time_col: str,
    labels: Sequence[str],
    size: str = "1 day",
    slide: str | None = None,
    watermark: str = "1 hour",
) -> DataFrame:
    """(start, labels..., n): class balance, or confusion counts when given label and prediction."""
    timed = with_event_time(stream, time_col, watermark)
    keys = [ref(c).cast("string").alias(c) for c in labels]
    return (
        timed.groupBy(_window(time_col, size, slide).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), *labels, "n")
    )
