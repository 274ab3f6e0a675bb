"""Dataset profile: missing values, types, correlations, histograms, outliers, summary statistics."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mldiag.functions.columns import (
    as_double,
    is_floating,
    missing_flag,
    numeric_columns,
    ref,
    share,
)
from mldiag.operators.gram import wide_correlation
from mldiag.operators.scale import exact_quantiles, global_cumsum, rank_picks, unpivot_features

#: Columns whose pairs still fit into one aggregate (820 buffers).
WIDE = 40


def normalise_nulls(df: DataFrame) -> DataFrame:
    """NaN in float and double columns becomes NULL, so both count as missing."""
    return df.select(
        *[
            F.when(~F.isnan(ref(f.name)), ref(f.name)).alias(f.name)
            if is_floating(f.dataType)
            else ref(f.name)
            for f in df.schema.fields
        ]
    )


def _rows(structs: Sequence[Column], df: DataFrame) -> DataFrame:
    """Turn a one-row frame into one row per struct."""
    return df.select(F.inline(F.array(*structs)))


def overview(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """One row: samples, features, missing_pct, duplicates.

    Equal rows collapse map-side and all four numbers come from the collapsed table in one pass.
    """
    clean = normalise_nulls(df)
    n_features = len(features if features is not None else numeric_columns(df))
    blanks = sum(
        (ref(c).isNull().cast("int") for c in clean.columns), F.lit(0)
    )
    # rows are told apart by 128 bits of hash; hashes pass over nulls, so their places are hashed as well
    places = F.concat(*[F.when(ref(c).isNull(), "1").otherwise("0") for c in clean.columns])
    columns = [places, *[ref(c) for c in clean.columns]]
    hashed = clean.select(
        F.xxhash64(*columns).alias("_h"), F.xxhash64(F.lit(1), *columns).alias("_g"), blanks.alias("_blanks")
    )
    grouped = hashed.groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("_n"), F.max("_blanks").alias("_blanks"))
    cells = F.sum("_n") * len(clean.columns)
    return grouped.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("samples"),
        F.lit(n_features).cast("bigint").alias("features"),
        F.coalesce(F.round(share(F.sum(F.col("_n") * F.col("_blanks")) * 100.0, cells), 2), F.lit(0.0)).alias(
            "missing_pct"
        ),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
    )


def missing_percent(df: DataFrame) -> DataFrame:
    """(column, missing_pct) for every column, in one scan."""
    fields = df.schema.fields
    sums = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(missing_flag(f)).alias(f"m{i}") for i, f in enumerate(fields)],
    )
    return _rows(
        [
            F.struct(
                F.lit(f.name).alias("column"),
                F.round(share(F.col(f"m{i}") * 100.0, F.col("n")), 2).alias("missing_pct"),
            )
            for i, f in enumerate(fields)
        ],
        sums,
    )


def _exact_dtypes(clean: DataFrame, fields: Sequence) -> DataFrame:
    """Distinct values by their 128-bit hashes: narrow (column, hash) rows that collapse map-side."""
    cells = [
        F.struct(
            F.lit(i).alias("i"),
            ref(f.name).isNull().alias("missing"),
            F.xxhash64(ref(f.name)).alias("h"),
            F.xxhash64(F.lit(1), ref(f.name)).alias("g"),
        )
        for i, f in enumerate(fields)
    ]
    values = clean.select(F.inline(F.array(*cells))).groupBy("i", "missing", "h", "g").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    sums = values.groupBy("i").agg(
        F.count(F.lit(1)).alias("unique_values"),
        F.sum(F.when(F.col("missing"), F.col("n")).otherwise(zero)).alias("missing_count"),
        F.sum("n").alias("n"),
    )
    names = F.array(*[F.lit(f.name) for f in fields])
    kinds = F.array(*[F.lit(f.dataType.simpleString()) for f in fields])
    every = clean.sparkSession.range(len(fields)).select(F.col("id").cast("int").alias("i"))
    return every.join(F.broadcast(sums), "i", "left").select(  # one row a column
        F.get(names, F.col("i")).alias("column"),
        F.get(kinds, F.col("i")).alias("dtype"),
        F.coalesce("unique_values", zero).alias("unique_values"),
        F.coalesce("missing_count", zero).alias("missing_count"),
        F.round(share(F.col("missing_count") * 100.0, F.col("n")), 2).alias("missing_pct"),
    )


def dtype_summary(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column, dtype, unique_values, missing_count, missing_pct); missing counts as one value."""
    fields = df.schema.fields
    clean = normalise_nulls(df)
    if not approximate:
        return _exact_dtypes(clean, fields)
    sums = clean.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.approx_count_distinct(ref(f.name)).alias(f"d{i}") for i, f in enumerate(fields)],
        *[F.count_if(ref(f.name).isNull()).alias(f"m{i}") for i, f in enumerate(fields)],
    )
    return _rows(
        [
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                (F.col(f"d{i}") + (F.col(f"m{i}") > 0).cast("int")).alias("unique_values"),
                F.col(f"m{i}").alias("missing_count"),
                F.round(share(F.col(f"m{i}") * 100.0, F.col("n")), 2).alias("missing_pct"),
            )
            for i, f in enumerate(fields)
        ],
        sums,
    )


def _pearson(x: Column, y: Column) -> Column:
    square, product = F.regr_r2(y, x), F.regr_sxy(y, x)
    flat = (product == 0) & (square == 1)  # what regr_r2 gives for a constant y
    return F.when(~flat, F.signum(product) * F.sqrt(square))


def correlation(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(x, y, corr) over pairwise complete rows, both triangles and the diagonal.

    Some columns take one scan with aggregates a pair; beyond WIDE of them, the products of rows are added up in blocks. A pair has no
    correlation without two different values on both sides (corr() itself raises there).
    """
    if len(features) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    if len(features) > WIDE:
        return wide_correlation(df, features)
    pairs = list(combinations_with_replacement(range(len(features)), 2))
    wide = df.select(*[as_double(f).alias(f"v{i}") for i, f in enumerate(features)]).agg(
        *[
            (_pearson(F.col(f"v{i}"), F.col(f"v{j}")) if i < j else F.when(F.var_pop(f"v{i}") > 0, 1.0)).alias(f"c{i}_{j}")
            for i, j in pairs
        ]
    )
    ordered = [(i, j, i, j) for i, j in pairs] + [(j, i, i, j) for i, j in pairs if i != j]
    return _rows(
        [
            F.struct(
                F.lit(features[x]).alias("x"),
                F.lit(features[y]).alias("y"),
                F.round(F.col(f"c{i}_{j}"), 3).alias("corr"),
            )
            for x, y, i, j in ordered
        ],
        wide,
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """(label, n) without missing labels."""
    return (
        df.where(ref(label).isNotNull())
        .groupBy(ref(label).cast("string").alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def histogram(df: DataFrame, features: Sequence[str], n_bins: int = 20) -> DataFrame:
    """(feature, bin, lo, hi, n) of equal-width bins, the last one closed; empty bins included.

    A constant feature gets the range value +- 0.5. Bin membership follows the printed edges, so a
    value equal to an edge opens the bin to its right.
    """
    long = unpivot_features(df, features)
    span = long.groupBy("feature").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    flat = F.col("a") == F.col("b")
    span = span.select(
        "feature",
        F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("first"),
        F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("last"),
    ).withColumn("step", (F.col("last") - F.col("first")) / n_bins)
    edge = lambda k: F.col("first") + k * F.col("step")
    guess = F.least(
        F.lit(n_bins - 1), F.floor((F.col("value") - F.col("first")) / F.col("step")).cast("int")
    )
    counted = (
        long.join(F.broadcast(span), "feature")  # one row per feature
        .withColumn("g", guess)
        .withColumn(
            "bin",
            F.when(F.col("value") < edge(F.col("g")), F.col("g") - 1)
            .when(
                (F.col("value") >= edge(F.col("g") + 1)) & (F.col("g") < n_bins - 1), F.col("g") + 1
            )
            .otherwise(F.col("g")),
        )
        .groupBy("feature", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    return every.join(counted, ["feature", "bin"], "left").select(
        "feature",
        "bin",
        F.round(edge(F.col("bin")), 6).alias("lo"),
        F.round(edge(F.col("bin") + 1), 6).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def outliers(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows outside Q1 - 1.5 IQR .. Q3 + 1.5 IQR per feature, with exact quartiles."""
    counts = unpivot_features(df, features).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    quartiles = rank_picks(
        global_cumsum(counts, ["feature"], "value", ["n"]), "feature", "n", [0.25, 0.75]
    ).select(
        "feature",
        "total",
        F.col("quantiles")[0].alias("q1"),
        F.col("quantiles")[1].alias("q3"),
    )
    fences = quartiles.withColumns(
        {
            "iqr": F.col("q3") - F.col("q1"),
            "lower": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
            "upper": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")),
        }
    )
    outside = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    keys = ["feature", "total", "q1", "q3", "iqr", "lower", "upper"]
    return (
        counts.join(F.broadcast(fences), "feature")  # one row per feature
        .groupBy(*keys)
        .agg(F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("outlier_count"))
        .select(
            "feature",
            *[F.round(c, 4).alias(c) for c in ("q1", "q3", "iqr")],
            F.round("lower", 4).alias("lower_fence"),
            F.round("upper", 4).alias("upper_fence"),
            "outlier_count",
            F.round(F.col("outlier_count") * 100.0 / F.col("total"), 2).alias("outlier_pct"),
        )
    )


def describe(df: DataFrame, features: Sequence[str], digits: int = 3) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max per feature."""
    long = unpivot_features(df, features)
    moments = long.groupBy("feature").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, [0.25, 0.5, 0.75]).select("feature", "quantiles")
    return moments.join(quartiles, "feature").select(
        "feature",
        "count",
        *[F.round(c, digits).alias(c) for c in ("mean", "std", "min")],
        *[
            F.round(F.col("quantiles")[i], digits).alias(name)
            for i, name in enumerate(("p25", "p50", "p75"))
        ],
        F.round("max", digits).alias("max"),
    )


def indicators(df: DataFrame, features: Sequence[str], label: str | None) -> DataFrame:
    """One row: samples, features, classes."""
    classes = F.count_distinct(ref(label)) if label else F.lit(0).cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("samples"),
        F.lit(len(features)).cast("bigint").alias("features"),
        classes.alias("classes"),
    )


def feature_ranges(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, start, end, step): the range searched for counterfactuals, min and max +- 10 %.

    A constant feature is first widened to value +- 1.
    """
    span = unpivot_features(df, features).groupBy("feature").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    flat = F.col("lo") == F.col("hi")
    span = span.select(
        "feature",
        F.when(flat, F.col("lo") - 1).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 1).otherwise(F.col("hi")).alias("hi"),
    ).withColumn("margin", (F.col("hi") - F.col("lo")) * 0.1)
    ends = span.select(
        "feature",
        (F.col("lo") - F.col("margin")).alias("start"),
        (F.col("hi") + F.col("margin")).alias("end"),
    )
    return ends.withColumn(
        "step", F.greatest((F.col("end") - F.col("start")) / 200, F.lit(1e-6))
    )
