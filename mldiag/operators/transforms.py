"""Table-to-table transforms for use with DataFrame.transform."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mldiag.functions.columns import as_double, doubles, numeric_columns, ref


def _statistics(df: DataFrame, columns: Sequence[str], aggregates) -> Column:
    """All column statistics of one scan as one struct-valued scalar."""
    values = [
        fn(as_double(c)).alias(f"{name}_{i}")
        for i, c in enumerate(columns)
        for name, fn in aggregates.items()
    ]
    return df.agg(F.struct(*values)).scalar()


def _replace(df: DataFrame, changed: dict[str, Column], stats: Column) -> DataFrame:
    with_stats = df.withColumn("_s", stats)
    return with_stats.select(
        *[changed[c].alias(c) if c in changed else ref(c) for c in df.columns]
    )


def impute_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values become the column mean; a column without any value becomes 0."""
    columns = list(columns or numeric_columns(df))
    stats = _statistics(df, columns, {"avg": F.avg})
    return _replace(
        df,
        {
            c: F.coalesce(as_double(c), F.col(f"_s.avg_{i}"), F.lit(0.0))
            for i, c in enumerate(columns)
        },
        stats,
    )


def normalize(
    df: DataFrame, method: str = "standard", columns: Sequence[str] | None = None
) -> DataFrame:
    """Standardise (population deviation) or min-max scale; a constant column becomes 0."""
    columns = list(columns or numeric_columns(df))
    if method == "standard":
        stats = _statistics(df, columns, {"shift": F.avg, "scale": F.stddev_pop})
        scale = lambda i: F.col(f"_s.scale_{i}")
    elif method == "minmax":
        stats = _statistics(df, columns, {"shift": F.min, "top": F.max})
        scale = lambda i: F.col(f"_s.top_{i}") - F.col(f"_s.shift_{i}")
    else:
        return df
    changed = {}
    for i, c in enumerate(columns):
        width = F.when(scale(i) == 0, F.lit(1.0)).otherwise(scale(i))
        changed[c] = (as_double(c) - F.col(f"_s.shift_{i}")) / width
    return _replace(df, changed, stats)


def feature_vector(df: DataFrame, features: Sequence[str], name: str = "embedding") -> DataFrame:
    """Append the numeric features as one array column."""
    return df.withColumn(name, F.array(*[ref(f).cast("double") for f in features]))


def feature_embedding(
    df: DataFrame, features: Sequence[str] | None = None, name: str = "embedding"
) -> DataFrame:
    """Append the mean-imputed numeric columns as a float vector."""
    features = list(features or numeric_columns(df))
    if not features:
        raise ValueError("no numeric columns for a feature embedding")
    stats = _statistics(df, features, {"avg": F.avg})
    parts = [
        F.coalesce(as_double(c), F.col(f"_s.avg_{i}"), F.lit(0.0)).cast("float")
        for i, c in enumerate(features)
    ]
    return df.withColumn("_s", stats).withColumn(name, F.array(*parts)).drop("_s")


def vector_columns(
    df: DataFrame, vector: str, n: int, prefix: str = "emb_", keep: Sequence[str] | None = None
) -> DataFrame:
    """First n vector elements as columns `<prefix>0..`; all other columns kept unless `keep` is given."""
    kept = [ref(c) for c in (keep if keep is not None else df.columns)]
    values = doubles(ref(vector))
    return df.select(*kept, *[F.get(values, F.lit(i)).alias(f"{prefix}{i}") for i in range(n)])


def decode_target(
    df: DataFrame, target: str, names: Sequence[str] | DataFrame, name: str = "label"
) -> DataFrame:
    """Append class names for integer codes 0..C-1, from a list or a (code, name) table.

    Unknown codes decode to NULL.
    """
    if isinstance(names, DataFrame):
        code, text = names.columns
        lookup = names.select(ref(code).alias("_code"), ref(text).alias(name))
        return df.join(lookup, ref(target) == F.col("_code"), "left").drop("_code")
    table = F.array(*[F.lit(n) for n in names])
    return df.withColumn(name, F.get(table, ref(target).cast("int")))
