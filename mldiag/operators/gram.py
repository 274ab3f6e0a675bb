"""Correlations of many columns by blocked products of rows, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mldiag.functions.columns import as_double, share

#: Columns on the left of one scan: a task adds up six tables of STRIP x columns numbers (240 MB at 5,000 columns).
STRIP = 1024
#: A variance below this share of the mean square about the centre is rounding error: the column is constant there.
FLAT = 1e-12

_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _matrix(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    """Rows x columns, missing values as NaN."""
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, columns)


def _centres(wide: DataFrame, columns: int) -> np.ndarray:
    """The mean of each column (0 without values): one number a column comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(columns, np.int64), np.zeros(columns)
        for batch in batches:
            x = _matrix(batch, columns)
            n += (~np.isnan(x)).sum(axis=0)
            total += np.nansum(x, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(columns, dtype=np.int32)), pa.array(n), pa.array(total)], ["i", "n", "total"])

    sums = wide.mapInArrow(run, "i int, n bigint, total double").groupBy("i").agg(share(F.sum("total"), F.sum("n")).alias("mean"))
    centre = np.zeros(columns)
    for row in sums.where("mean is not null").collect():
        centre[row.i] = row.mean
    return np.where(np.isfinite(centre), centre, 0.0)


def _strip(wide: DataFrame, lo: int, hi: int, centre: np.ndarray) -> DataFrame:
    """(i, j, sums) for the columns lo to hi with themselves and those after them: what one task adds up, pair by pair."""
    columns = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {name: np.zeros((hi - lo, columns - lo)) for name in _SUMS}
        for batch in batches:
            x = _matrix(batch, columns)[:, lo:] - centre[lo:]
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            there = there.astype(float)
            a, has = x[:, : hi - lo].T, there[:, : hi - lo].T
            sums["n"] += has @ there
            sums["sx"] += a @ there
            sums["sy"] += has @ x
            sums["sxx"] += (a * a) @ there
            sums["syy"] += has @ (x * x)
            sums["sxy"] += a @ x
        for i in range(hi - lo):
            j = np.arange(lo + i, columns, dtype=np.int32)
            cells = [pa.array(sums[name][i, i:]) for name in _SUMS]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), lo + i, np.int32)), pa.array(j), *cells], ["i", "j", *_SUMS])

    return wide.mapInArrow(run, "i int, j int, " + ", ".join(f"{name} double" for name in _SUMS))


def wide_correlation(df: DataFrame, features: Sequence[str], strip: int = STRIP) -> DataFrame:
    """(x, y, corr) over pairwise complete rows, both triangles and the diagonal.

    One scan finds the columns' means, one more for every `strip` columns adds up products about them; each task sends its sums once,
    whatever its rows, and pairs are added up by key. A pair has no correlation without two different values on both sides; an empty
    table has none at all, only its pairs.
    """
    if len(features) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    columns = len(features)
    wide = df.select(F.array(*[as_double(f) for f in features]).alias("row"))
    centre = _centres(wide, columns)
    strips = [_strip(wide, lo, min(lo + strip, columns), centre) for lo in range(0, columns, strip)]
    ids = df.sparkSession.range(columns).select(F.col("id").cast("int").alias("i"))
    none = ids.select("i", F.explode(F.sequence(F.col("i"), F.lit(columns - 1))).alias("j"), *[F.lit(0.0).alias(name) for name in _SUMS])
    sums = reduce(DataFrame.unionByName, strips, none).groupBy("i", "j").agg(*[F.sum(name).alias(name) for name in _SUMS])
    vx, vy = (F.col(f"s{c}{c}") - F.col(f"s{c}") * share(F.col(f"s{c}"), F.col("n")) for c in "xy")
    varied = (vx > FLAT * F.col("sxx")) & (vy > FLAT * F.col("syy"))
    both = F.col("sxy") - F.col("sx") * share(F.col("sy"), F.col("n"))
    pairs = sums.select("i", "j", F.when(varied, F.round(both / F.sqrt(vx) / F.sqrt(vy), 3)).alias("corr"))
    names = F.array(*[F.lit(f) for f in features])
    turned = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    )
    out = pairs.select(F.explode(turned).alias("p"), "corr")
    return out.select(F.get(names, F.col("p.i")).alias("x"), F.get(names, F.col("p.j")).alias("y"), "corr")
