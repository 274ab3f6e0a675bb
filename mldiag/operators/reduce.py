"""Projection of embeddings to two (or three) coordinates."""

from __future__ import annotations

import gc
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, SparseVector, VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mldiag.functions.columns import (
    dot,
    doubles,
    euclidean,
    literal_matrix,
    literal_vector,
    numeric_columns,
    ref,
)
from mldiag.operators.scale import hash_sample

AXES = ("x", "y", "z")
DENSE_DIMENSIONS = 4096
#: Dimensions of which the driver holds columns of numbers; and entries that a task holds of more.
DRIVER_DIMENSIONS, GROUP_ENTRIES = 200_000, 8_000_000
#: Numbers of the landmark matrix that are held at once.
MOST_CELLS = 20_000_000


def _is_vector(df: DataFrame, vector: str) -> bool:
    return isinstance(df.schema[vector].dataType, VectorUDT)


def _vector_size(df: DataFrame, vector: str) -> int:
    column = vector_to_array(ref(vector)) if _is_vector(df, vector) else ref(vector)
    row = df.where(ref(vector).isNotNull()).select(F.size(column)).first()
    return row[0] if row else 0


def _append(df: DataFrame, coordinates: Column, n: int) -> DataFrame:
    placed = df.withColumn("_xy", coordinates)
    return placed.withColumns({AXES[i]: F.col("_xy")[i] for i in range(n)}).drop("_xy")


def _indexed(vector) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of a sparse or dense vector, or of a list."""
    if isinstance(vector, SparseVector):
        return vector.indices, vector.values
    values = vector.toArray() if isinstance(vector, DenseVector) else np.asarray(vector, dtype=float)
    return np.arange(len(values)), values


def _centred_products(rows: DataFrame, vector: str, basis: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Covariance-like product: sum over rows x of x ((x - mean) basis), dimensions x columns.

    Tasks add up their rows; what is shuffled and collected is one row per dimension and basis column set.
    """
    shift = mean @ basis

    def add(part):
        def summed(block):
            sizes = np.array([len(at) for at, _ in block])
            at, values = (np.concatenate([b[i] for b in block]) for i in (0, 1))
            row = np.repeat(np.arange(len(block)), sizes)
            parts = values[:, None] * basis[at]
            t = np.column_stack([np.bincount(row, weights=p, minlength=len(block)) for p in parts.T]) - shift
            order = np.argsort(at, kind="stable")
            kinds, starts = np.unique(at[order], return_index=True)
            sums = np.add.reduceat((values[:, None] * t[row])[order], starts, axis=0) if len(at) else np.zeros((0, len(shift)))
            return zip(kinds.tolist(), sums.tolist())

        block = []
        for (v,) in part:
            block.append(_indexed(v))
            if len(block) == 4096:
                yield from summed(block)
                block = []
        if block:
            yield from summed(block)

    def add_dense(part):
        block, total = [], np.zeros(basis.shape)
        for (v,) in part:
            block.append(np.asarray(v, dtype=float) if isinstance(v, list) else v.toArray())
            if len(block) == 1024:
                x = np.stack(block)
                total += x.T @ (x @ basis - shift)
                block = []
        if block:
            x = np.stack(block)
            total += x.T @ (x @ basis - shift)
        return ((i, t.tolist()) for i, t in enumerate(total))

    # the vector type has no Arrow form, hence the row iterator
    dense = len(mean) <= DENSE_DIMENSIONS
    found = rows.select(vector).rdd.mapPartitions(add_dense if dense else add).toDF("i bigint, t array<double>")
    sums = found.groupBy("i").agg(*[F.sum(F.col("t")[j]).alias(f"t{j}") for j in range(basis.shape[1])])
    out = np.zeros(basis.shape)
    for r in sums.collect():
        out[r["i"]] = r[1:]
    return out


def pca(df: DataFrame, vector: str, n_components: int = 2, passes: int = 5, extra: int = 64, seed: int = 42) -> DataFrame:
    """Append centred principal coordinates; each axis has its largest loading positive.

    Randomised subspace iteration (Halko, Martinsson and Tropp, 2011): each pass multiplies a basis of a few columns by
    the covariance, so the driver holds dimensions x columns numbers, never a square matrix. Up to `extra` dimensions
    of an array column count, sums and products come from one pass, which is exact. Beyond `DRIVER_DIMENSIONS` of ML vectors the basis stays with
    the tasks that hold its dimensions, and the driver has rows x columns numbers. A row without a vector has null coordinates, and so have all
    rows of a table without any.
    """
    first = df.where(ref(vector).isNotNull()).select(ref(vector).alias("v")).first()
    if first is None:
        return _append(df, F.lit(None).cast("array<double>"), n_components)
    if _is_vector(df, vector) and first["v"].size > DRIVER_DIMENSIONS:
        return _pca_by_columns(df, vector, n_components, passes, n_components + 8, seed)
    if not _is_vector(df, vector) and len(first["v"]) <= extra:
        mean, covariance = _moments(df, vector, np.asarray(first["v"], dtype=float))
        values, vectors = np.linalg.eigh(covariance)
        return _project(df, vector, vectors[:, np.argsort(values)[::-1][:n_components]], mean)
    rows = df.where(ref(vector).isNotNull()).select(ref(vector)).persist()  # read by every pass
    size = _vector_size(rows, vector)
    n = rows.count()
    ml = ref(vector) if _is_vector(df, vector) else array_to_vector(doubles(ref(vector)))
    mean = rows.select(Summarizer.mean(ml).alias("m")).first()["m"].toArray()
    width = min(size, max(n_components + 8, extra if size <= extra else n_components + 8))
    complete = width == size
    basis = np.eye(size) if complete else np.linalg.qr(np.random.RandomState(seed).normal(size=(size, width)))[0]
    for _ in range(0 if complete else passes):
        basis = np.linalg.qr(_centred_products(rows, vector, basis, mean))[0]
    small = basis.T @ _centred_products(rows, vector, basis, mean) / max(n - 1, 1)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    rows.unpersist()
    return _project(df, vector, basis @ vectors[:, np.argsort(values)[::-1][:n_components]], mean)


def _pca_by_columns(df: DataFrame, vector: str, n_components: int, passes: int, width: int, seed: int) -> DataFrame:
    """`pca` of sparse vectors with more dimensions than the driver should hold columns of.

    Dimensions are dealt to groups once. The iteration runs on the rows' side: with centred orthonormal columns q of the rows, a group makes its own
    part z of x'q and adds x z to the next columns, so no basis of the dimensions is ever sent. The last product gives the best axes within x'q.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    rows = df.where(ref(vector).isNotNull()).select(ref(vector)).rdd
    entries = rows.map(lambda r: len(_indexed(r[0])[0])).sum()
    groups = max(context.defaultParallelism, -(-entries // GROUP_ENTRIES))

    def deal(part_number, part):
        def pieces(block, number):
            of = np.repeat(np.arange(len(block), dtype=np.int32), [len(at) for at, _ in block])
            at, x = (np.concatenate([b[i] for b in block]) for i in (0, 1))
            order = np.argsort(at % groups, kind="stable")
            of, at, x = of[order], at[order].astype(np.int32), x[order]
            ends = np.searchsorted(at % groups, np.arange(groups + 1))
            for g, (a, b) in enumerate(zip(ends, ends[1:])):  # a piece for each group, empty or not
                yield g, ((part_number, number), len(block), of[a:b], at[a:b], x[a:b])

        block, number = [], 0
        for (v,) in part:
            block.append(_indexed(v))
            if len(block) == 4096:
                yield from pieces(block, number)
                block, number = [], number + 1
        if block:
            yield from pieces(block, number)

    dealt = rows.mapPartitionsWithIndex(deal).partitionBy(groups, lambda g: g)  # every pass reads the same shuffle
    sizes = dict(dealt.filter(lambda p: p[0] == 0).map(lambda p: p[1][:2]).collect())
    first, n = {}, 0
    for block in sorted(sizes):
        first[block], n = n, n + sizes[block]

    def held(part, q):
        pieces = [p for _, p in part]
        if not pieces or not sum(len(p[2]) for p in pieces):
            return None
        row = np.concatenate([p[2] + np.int32(first[p[0]]) for p in pieces])
        known, code = np.unique(np.concatenate([p[3] for p in pieces]), return_inverse=True)
        x = np.concatenate([p[4] for p in pieces])
        del pieces
        z = np.column_stack([np.bincount(code, weights=x * q[row, j], minlength=len(known)) for j in range(q.shape[1])])
        return row, known, code, x, z

    def product(q, kind):
        sent = context.broadcast(q)

        def add(part):
            found = held(part, sent.value)
            if found:
                row, _, code, x, z = found
                y = np.column_stack([np.bincount(row, weights=x * z[code, j], minlength=n) for j in range(z.shape[1])]).astype(kind)
                yield from ((start, y[start : start + 65536]) for start in range(0, n, 65536))

        out = np.zeros(q.shape)
        for start, y in dealt.mapPartitions(add).reduceByKey(lambda a, b: a + b).collect():
            out[start : start + len(y)] = y
        sent.destroy()
        return out

    centred = lambda y: y - y.mean(0)
    q = np.linalg.qr(centred(np.random.RandomState(seed).normal(size=(n, min(width, n)))))[0]
    for _ in range(passes):
        q = np.linalg.qr(centred(product(q, np.float32)))[0]
        q = np.linalg.qr(centred(q))[0]  # a column that was lost to rounding need not be centred
        gc.collect()
        spark._jvm.System.gc()  # else shuffles of past passes stay until the driver happens to collect its garbage
    raw = product(q, float)
    values, vectors = np.linalg.eigh(q.T @ centred(raw))
    keep = values > 1e-12 * max(values.max(), 1e-300)
    root = vectors[:, keep] / np.sqrt(values[keep])
    y = centred(raw) @ root
    values, vectors = np.linalg.eigh(y.T @ y)
    axes = root @ vectors[:, np.argsort(values)[::-1][:n_components]]
    axes = np.column_stack([axes, np.zeros((len(axes), n_components - axes.shape[1]))])
    sent = context.broadcast(q @ axes)

    def load(part):
        found = held(part, sent.value)
        return [(found[1], found[4])] if found else []

    loadings = np.zeros((df.where(ref(vector).isNotNull()).select(ref(vector)).first()[0].size, n_components))
    for at, z in dealt.mapPartitions(load).collect():
        loadings[at] = z
    return _project(df, vector, loadings, offset=raw.mean(0) @ axes)


def _moments(df: DataFrame, vector: str, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance in one pass over arrays of few dimensions; each task leaves a row a dimension."""
    size = len(shift)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy()) - shift
                x = np.column_stack([x, np.ones(len(x))])  # the last column counts and sums
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(size + 1), "t": total.tolist()})

    rows = df.select(doubles(ref(vector)).alias("v")).where(F.col("v").isNotNull())
    found = rows.mapInPandas(add, "i int, t array<double>")
    sums = found.groupBy("i").agg(*[F.sum(F.get("t", F.lit(j))).alias(f"t{j}") for j in range(size + 1)])
    out = np.zeros((size + 1, size + 1))
    for r in sums.collect():
        out[r["i"]] = r[1:]
    n, near = out[size, size], out[size, :size] / out[size, size]
    return shift + near, (out[:size, :size] - n * np.outer(near, near)) / max(n - 1, 1)


def _project(df: DataFrame, vector: str, loadings: np.ndarray, mean: np.ndarray | None = None, offset: np.ndarray | None = None) -> DataFrame:
    """Append the coordinates on the axes, each turned so that its largest loading is positive, from the mean or its coordinates."""
    n_components = loadings.shape[1]
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(n_components)])
    signs = np.where(signs == 0, 1.0, signs)
    loadings = loadings * signs
    offset = mean @ loadings if offset is None else offset * signs
    if _is_vector(df, vector):

        @F.udf("array<double>")  # the vector type has no Arrow form
        def place(v):
            if v is None:
                return None
            at, x = _indexed(v)
            return (x @ loadings[at] - offset).tolist()

        return _append(df, place(ref(vector)), n_components)
    axes = F.array(*[dot(literal_vector(w), doubles(ref(vector))) - F.lit(float(o)) for w, o in zip(loadings.T, offset)])
    return _append(df, axes, n_components)


def _landmark_distances(df: DataFrame, vector: str, points: list) -> Column:
    """Squared distances to the landmarks, an array per row."""
    if not _is_vector(df, vector):
        matrix = [list(p) for p in points]
        return F.transform(literal_matrix(matrix), lambda l: F.pow(euclidean(doubles(ref(vector)), l), F.lit(2)))
    # only dimensions that some landmark has matter to the products: of each, the landmarks that have it
    parts = [_indexed(p) for p in points]
    at, x = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    of = np.repeat(np.arange(len(parts)), [len(a) for a, _ in parts])
    order = np.argsort(at, kind="stable")[(x != 0)[np.argsort(at, kind="stable")]]
    held, whose = x[order], of[order]
    known, first = np.unique(at[order], return_index=True)
    ends = np.append(first, len(order))
    lengths = np.bincount(of, weights=x * x, minlength=len(parts))

    @F.udf("array<double>")
    def measure(v):
        if v is None:
            return None
        at, x = _indexed(v)
        place = np.searchsorted(known, at)
        hit = np.append(known, -1)[place] == at
        place, own = place[hit], x[hit]
        size = ends[place + 1] - ends[place]
        entry = np.repeat(ends[place] - np.cumsum(size) + size, size) + np.arange(size.sum())
        products = np.bincount(whose[entry], weights=held[entry] * np.repeat(own, size), minlength=len(lengths))
        return np.maximum((x**2).sum() + lengths - 2 * products, 0.0).tolist()

    return measure(ref(vector))


def landmark_mds(
    df: DataFrame, id_col: str, vector: str, n_components: int = 2, landmarks: int = 200, seed: int = 42
) -> DataFrame:
    """Append coordinates by landmark multidimensional scaling (de Silva and Tenenbaum, 2004).

    The only non-linear-distance job on the driver is the eigenproblem of the landmark block (at
    most `landmarks` rows); every row is placed by its distances to the landmarks, in a column. A row without a vector has null
    coordinates, and so have all rows of a table without any.
    """
    point = ref(vector) if _is_vector(df, vector) else doubles(ref(vector))
    known_rows = df.select(ref(id_col).alias("id"), point.alias("v")).where(F.col("v").isNotNull())
    sample = hash_sample(known_rows, "id", landmarks, seed).collect()
    if not sample:
        return _append(df, F.lit(None).cast("array<double>"), n_components)
    parts = [_indexed(r["v"]) for r in sample]
    known = np.unique(np.concatenate([at for at, _ in parts]))
    n = len(parts)
    products = np.zeros((n, n))
    for some in np.array_split(known, max(1, -(-n * len(known) // MOST_CELLS))):
        points = np.zeros((n, len(some)))
        for row, (at, x) in enumerate(parts):
            here = np.isin(at, some)
            points[row, np.searchsorted(some, at[here])] = x[here]
        products += points @ points.T
    lengths = products.diagonal()
    squared = np.maximum(lengths[:, None] + lengths[None, :] - 2 * products, 0.0)
    centring = np.eye(n) - 1.0 / n
    values, vectors = np.linalg.eigh(-0.5 * centring @ squared @ centring)
    top = np.argsort(values)[::-1][:n_components]
    missing = n_components - len(top)  # fewer landmarks than axes: the others are 0
    values, vectors = np.maximum(values[top], 1e-12), vectors[:, top]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(top))])
    vectors = vectors * np.where(signs == 0, 1.0, signs)
    pseudo = vectors.T / np.sqrt(values)[:, None]
    near = _landmark_distances(df, vector, [r["v"] for r in sample])
    rows = df.withColumn("_d2", F.zip_with(near, literal_vector(squared.mean(0)), lambda d, m: m - d))
    flat = [F.when(F.col("_d2").isNotNull(), 0.0)] * missing
    axes = F.array(*[0.5 * dot(literal_vector(p), F.col("_d2")) for p in pseudo], *flat)
    return _append(rows, axes, n_components).drop("_d2")


def reduce2d(
    df: DataFrame, method: str = "pca", vector: str = "embedding", n_components: int = 2,
    id_col: str | None = None, **options,
) -> DataFrame:
    """Append x, y (, z). An embedding with no more dimensions than asked for is passed through."""
    size = _vector_size(df, vector)
    if size == 0 and method in ("pca", "landmark_mds"):  # no row has a vector
        return _append(df, F.lit(None).cast("array<double>"), n_components)
    if size <= n_components:
        column = vector_to_array(ref(vector)) if _is_vector(df, vector) else doubles(ref(vector))
        return df.withColumns({AXES[i]: F.get(column, F.lit(i)) for i in range(size)})
    if method == "pca":
        return pca(df, vector, n_components)
    if method == "landmark_mds":
        if id_col is None:
            raise ValueError("landmark_mds needs the id column")
        return landmark_mds(df, id_col, vector, n_components, **options)
    raise ValueError(f"Unknown method: {method}")


def reduce_transform(
    df: DataFrame, method: str = "pca", columns: Sequence[str] | None = None, id_col: str | None = None
) -> DataFrame:
    """Append x, y from the given columns, else the emb_* columns, else all numeric ones."""
    columns = list(columns or [c for c in df.columns if c.startswith("emb_")] or numeric_columns(df))
    rows = df.withColumn("_v", F.array(*[ref(c).cast("double") for c in columns]))
    return reduce2d(rows, method, "_v", id_col=id_col).drop("_v")
