"""Column expressions shared by the operators. Everything here stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ref(name: str) -> Column:
    """Column by exact name, also when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def as_double(name: str) -> Column:
    """Numeric column as double with NaN read as missing."""
    value = ref(name).cast("double")
    return F.when(~F.isnan(value), value)


def missing_flag(field: T.StructField) -> Column:
    column = ref(field.name)
    absent = column.isNull()
    return absent | F.isnan(column) if is_floating(field.dataType) else absent


def same(left: Column, right: Column) -> Column:
    """Label equality: both sides as strings, a missing side never matches."""
    return F.coalesce(left.cast("string") == right.cast("string"), F.lit(False))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0.0 when the denominator is 0."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))


def share(top: Column, bottom: Column) -> Column:
    """top / bottom, NULL when there is nothing to divide by."""
    return F.try_divide(top, bottom)


def _sql_vector(values: Sequence[float]) -> str:
    return "array(" + ",".join(f"{float(v)!r}D" for v in values) + ")"


def literal_vector(values: Sequence[float]) -> Column:
    return F.expr(_sql_vector(values))


def literal_matrix(rows: Sequence[Sequence[float]]) -> Column:
    return F.expr("array(" + ",".join(_sql_vector(r) for r in rows) + ")")


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v
    )


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity, kept inside [0, 2]; a zero vector has similarity 0."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    similarity = F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - similarity))


def entropy_bits(probability: Column) -> Column:
    """Prediction entropy in bits; probabilities are clipped to [1e-12, 1]."""
    clipped = F.transform(
        probability, lambda p: F.greatest(F.lit(1e-12), F.least(F.lit(1.0), p))
    )
    return -F.aggregate(clipped, F.lit(0.0), lambda s, p: s + p * F.log2(p))


def max_entropy(n_classes: Column) -> Column:
    """log2 of the class count; 1 when there are fewer than two classes."""
    return F.when(n_classes > 1, F.log2(n_classes.cast("double"))).otherwise(F.lit(1.0))


def top_probability(probability: Column, rank: int) -> Column:
    """The rank-th largest probability (0-based), 0 when there are too few classes."""
    ordered = F.sort_array(probability, asc=False)
    return F.coalesce(F.get(ordered, F.lit(rank)), F.lit(0.0))


def argmax_name(probability: Column, classes: Sequence[str]) -> Column:
    """Name of the first class with the largest probability."""
    names = F.array(*[F.lit(c) for c in classes])
    return F.element_at(names, F.array_position(probability, F.array_max(probability)).cast("int"))


def hash_fraction_key(identifier: Column, seed: int) -> Column:
    """Reproducible pseudo-random sort key of a row: md5 of its id and the seed."""
    return F.md5(F.concat(identifier.cast("string"), F.lit(f":{seed}")))


def hash_number(text: Column) -> Column:
    """First 32 bits of an md5 as a non-negative bigint."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def kolmogorov_pvalue(statistic: Column, n_ref: Column, n_prod: Column) -> Column:
    """Two-sample Kolmogorov tail probability.

    The limiting series with the small-sample shift of the argument published by Vrbik (2018);
    the series is not usable near 0, where the probability is 1.
    """
    n = F.round(n_ref.cast("double") * n_prod / (n_ref + n_prod))
    root = F.sqrt(n)
    lam = root * statistic + 1 / (6 * root) + (root * statistic - 1) / (4 * n)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda s, j: s + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * lam * lam),
    )
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(bounded)
