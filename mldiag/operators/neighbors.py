"""Similarity search and clustering on embeddings."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from mldiag.functions.columns import cosine_distance, dot, doubles, euclidean, ref
from mldiag.operators.blocks import CHUNK, away, left_rows, met, packed, squares, stacked
from mldiag.operators.scale import global_rank, hash_sample, spread
from mldiag.session import cut_lineage

MAX_CELLS = 1024


def similar_rows(
    df: DataFrame,
    id_col: str,
    vector: str,
    query_id,
    k: int = 10,
    metric: str = "cosine",
    label: str | None = None,
) -> DataFrame:
    """(rank, id, distance, label): the k rows nearest to one row, itself left out by id.

    A scan with a per-task top-k; nothing but k rows is shuffled.
    """
    measure = cosine_distance if metric == "cosine" else euclidean
    query = df.where(ref(id_col) == F.lit(query_id)).select(doubles(ref(vector))).scalar()
    kept = [ref(id_col).alias("id"), doubles(ref(vector)).alias("_v")]
    kept.append((ref(label).cast("string") if label else F.lit(None).cast("string")).alias("label"))
    near = (
        df.where(ref(id_col) != F.lit(query_id))
        .select(*kept)
        .withColumn("_q", query)
        .where(F.col("_q").isNotNull())
        .select("id", "label", measure(F.col("_v"), F.col("_q")).alias("_d"))
        .orderBy("_d", "id")
        .limit(k)
    )
    place = F.row_number().over(Window.orderBy("_d", "id"))  # over k rows
    return near.select(
        place.alias("rank"), "id", F.round("_d", 6).alias("distance"), "label"
    )


def nearest_point(df: DataFrame, id_col: str, x: float, y: float, xc: str = "x", yc: str = "y") -> DataFrame:
    """One row: the id of the plotted point closest to (x, y), the smallest id on ties."""
    dx, dy = ref(xc) - F.lit(float(x)), ref(yc) - F.lit(float(y))
    squared = dx * dx + dy * dy
    best = F.min(F.struct(squared.alias("d2"), ref(id_col).alias("id")))
    return df.agg(best.alias("b")).select(
        F.col("b.id").alias("id"), F.round(F.sqrt("b.d2"), 6).alias("distance")
    )


def _unit(df: DataFrame, vector: str) -> DataFrame:
    """Scale vectors to length 1 (zero vectors stay), so that cosine order is Euclidean order."""
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    return df.withColumn("_n", norm).withColumn(
        vector, F.when(F.col("_n") > 0, F.transform(vector, lambda v: v / F.col("_n"))).otherwise(F.col(vector))
    ).drop("_n")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by one matrix product; may be off by rounding."""
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(squared, 0.0))


class _Nearest:
    """The `need` nearest points of a block's rows among those met so far; ties go to the smallest id."""

    def __init__(self, reps: np.ndarray, q: np.ndarray, need: int):
        self.reps, self.q, self.need = reps, q, need
        self.bound = np.full(len(q), np.inf)  # distance of the last one kept
        self.distance, self.id = np.full((len(q), need), np.inf), np.zeros((len(q), need), np.int64)
        self.carried = np.full((len(q), need), None, object)

    def add(self, rows: np.ndarray, t_ids: np.ndarray, t: np.ndarray, carried: np.ndarray) -> None:
        """The matrix product in single precision preselects points for some of the rows, direct differences decide."""
        found, middle = [], t.mean(0)  # distances are the same from anywhere, and rounding is least from the middle
        for at in range(0, len(rows), CHUNK):
            some = rows[at : at + CHUNK]
            for kind in (np.float32, float):
                near, slack = squares(self.q[some] - middle, t - middle, kind)
                limit = self.bound[some] ** 2
                if len(t) >= self.need and not np.isfinite(limit).all():
                    new = np.flatnonzero(~np.isfinite(limit))
                    limit[new] = np.partition(near[new], self.need - 1, axis=1)[:, self.need - 1] + slack[new]
                limit = np.nextafter((limit * (1 + 1e-12) + slack).astype(kind), kind(np.inf))
                hit = np.flatnonzero(near <= limit[:, None])
                if len(hit) <= 16 * self.need * len(some):
                    break  # else too many are about as near as the last one for single precision
            found.append((some[hit // len(t)], hit % len(t)))
        row, pick = (np.concatenate(x) for x in zip(*found))
        touched, row = np.unique(row, return_inverse=True)
        distance = np.concatenate([self.distance[touched].ravel(), away(self.q[touched[row]], t[pick])])
        ids = np.concatenate([self.id[touched].ravel(), t_ids[pick]])
        brought = np.concatenate([self.carried[touched].ravel(), carried[pick]])
        row = np.concatenate([np.repeat(np.arange(len(touched)), self.need), row])
        order = np.lexsort((ids, distance, row))
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row, "left") < self.need].reshape(len(touched), self.need)
        self.distance[touched], self.id[touched], self.carried[touched] = distance[order], ids[order], brought[order]
        self.bound[touched] = self.distance[touched, -1]

    def result(self) -> pd.DataFrame:
        size = np.isfinite(self.distance).sum(1)
        rows = np.flatnonzero(size)
        cut = lambda x: [x[i, : size[i]] for i in rows]
        return pd.DataFrame({"rep": self.reps[rows], "distances": cut(self.distance), "neighbors": cut(self.id), "carried": [list(x) for x in cut(self.carried)]})


def _first_copies(points: DataFrame, need: int) -> DataFrame:
    """Of identical vectors only the `need` smallest ids can be among anyone's nearest."""
    order = Window.partitionBy("v").orderBy("id")
    return points.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= need).drop("_r")


def knn_join(
    queries: DataFrame,
    points: DataFrame,
    id_col: str,
    vector: str,
    k: int,
    metric: str = "euclidean",
    exclude_self: bool = False,
    carry: str | None = None,
    n_cells: int | None = None,
    block_rows: int = 4096,
) -> DataFrame:
    """(id, rank, neighbor, distance, carried): the exact k nearest `points` of every query row.

    Copies are answered once: queries collapse to distinct vectors, and of identical points only the
    first few ids are kept. The rest follows the pivot method of Lu, Shen, Chen and Ooi (2012):
    points are grouped by their nearest pivot, each group's radius and k smallest pivot distances are
    collected (bounded by the pivot count), and the triangle inequality tells which groups can hold
    a query's neighbours; only with those is it compared. Both sides are packed into blocks of about
    `block_rows` rows, so a group that holds a third of all points is many blocks, and are kept once:
    no copy of a row is made for each pair of blocks. Ids may be of any type that orders; `carry` names a column of `points` to bring along as text.
    """
    spark = points.sparkSession
    need = k + 1 if exclude_self else k
    carried = ref(carry).cast("string") if carry else F.lit(None).cast("string")
    v = doubles(ref(vector)).alias("v")
    q = queries.select(ref(id_col).alias("key"), v).where(F.col("v").isNotNull())
    t = points.select(ref(id_col).alias("key"), v, carried.alias("carried")).where(F.col("v").isNotNull())
    numbers = None
    if isinstance(points.schema[id_col].dataType, IntegralType):
        t = t.withColumn("id", F.col("key").cast("bigint"))
    else:  # numbered in the order of the ids, so that ties go to the smallest id as well
        numbers = cut_lineage(global_rank(t.select(F.col("key").alias("name")).distinct(), "name", "id"))
        t = t.join(numbers, t["key"] == numbers["name"]).drop("name")
    if metric == "cosine":
        q, t = _unit(q, "v"), _unit(t, "v")
    t = cut_lineage(_first_copies(t.select("id", "v", "carried"), need))  # read by four jobs below
    # each distinct query vector gets a number, and rows join by it: a vector that many rows share is one narrow hot key
    q = q.withColumn("hash", F.xxhash64("v"))
    reps = cut_lineage(q.groupBy("hash", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("rep", F.monotonically_increasing_id()))
    found = _pivot_join(spark, reps, t, need, n_cells, block_rows)
    d = F.transform("distances", lambda d: d * d / 2) if metric == "cosine" else F.col("distances")
    near = F.arrays_zip(d.alias("distance"), F.col("neighbors").alias("neighbor"), "carried")
    best = found.select("rep", near.alias("near"))  # in order, at most `need` a row
    named = reps.join(best, "rep").select("hash", F.col("v").alias("rep_v"), "near")
    answered = q.join(named, (q["hash"] == named["hash"]) & (q["v"] == named["rep_v"])).select("key", "near")
    rows = answered.select("key", F.posexplode("near").alias("_i", "n")).select(
        "key", (F.col("_i") + 1).alias("rank"), F.col("n.neighbor").alias("neighbor"), "n.distance", "n.carried"
    )
    if numbers is not None:
        rows = rows.join(numbers.select(F.col("id").alias("neighbor"), "name"), "neighbor").drop("neighbor")
        rows = rows.withColumnRenamed("name", "neighbor")
    if exclude_self:  # of the one neighbour more that was sought, the row itself goes, or else the last one
        own = F.max(F.when(F.col("neighbor") == F.col("key"), F.col("rank"))).over(Window.partitionBy("key"))
        rows = rows.withColumn("_own", F.coalesce(own, F.lit(need))).where(F.col("rank") != F.col("_own"))
        rows = rows.withColumn("rank", F.col("rank") - (F.col("rank") > F.col("_own")).cast("int"))
    return rows.where(F.col("rank") <= k).select(F.col("key").alias("id"), "rank", "neighbor", "distance", "carried")


_FOUND = "rep bigint, distances array<double>, neighbors array<bigint>, carried array<string>"


def _pivot_join(
    spark, reps: DataFrame, t: DataFrame, need: int, n_cells: int | None, block_rows: int
) -> DataFrame:
    """(rep, distances, neighbors, carried): the `need` nearest points of each query vector, nearest first.

    Points are packed into blocks of one cell, queries into blocks of any. Every block of queries meets every block of points where it lies,
    without a shuffle; only the rows of which the cell can hold a neighbour, by its radius and by what they have found, are measured.
    """
    n_points = t.count()
    n_cells = n_cells or max(1, min(MAX_CELLS, math.ceil(n_points / block_rows)))
    if n_cells == 1 and 0 < n_points <= block_rows:
        return _block_join(reps, t, need, block_rows)
    pivots = np.array([r["v"] for r in hash_sample(t, "id", n_cells).collect()], dtype=float)
    if len(pivots) == 0:
        return spark.createDataFrame([], _FOUND)

    def to_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = _distances(np.stack(batch["v"].to_numpy()), pivots)
                cell = d.argmin(1)
                yield batch.assign(cell=cell, d=d[np.arange(len(cell)), cell])

    placed = cut_lineage(
        t.mapInPandas(to_cell, "id bigint, v array<double>, carried string, cell int, d double")
    )
    per_cell = Window.partitionBy("cell").orderBy("d", "id")
    closest = (
        placed.select("cell", "d", "id")
        .withColumn("r", F.row_number().over(per_cell))
        .where(F.col("r") <= need)
        .groupBy("cell")
        .agg(F.array_sort(F.collect_list("d")).alias("closest"))
    )
    extent = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius"))
    stats = sorted(extent.join(closest, "cell").collect(), key=lambda r: r["cell"])
    cells = np.array([r["cell"] for r in stats])
    radius = np.array([r["radius"] for r in stats])
    closest_of = [np.array(r["closest"]) for r in stats]

    def asked(frame: pd.DataFrame) -> tuple:
        return frame["rep"].to_numpy(), stacked(frame["v"])

    def held(frame: pd.DataFrame) -> tuple:
        return frame["id"].to_numpy(), stacked(frame["v"]), frame["carried"].to_numpy(object)

    class Asking(_Nearest):
        def __init__(self, number: int, payload: tuple):
            super().__init__(*payload, need)
            self.d = _distances(self.q, pivots[cells])
            self.reach = np.full(len(self.q), np.inf)
            if n_points > need:  # the nearest of all cells, by way of their pivots
                best = np.full((len(self.q), need), np.inf)
                for j, c in enumerate(closest_of):
                    best = np.partition(np.concatenate([best, self.d[:, [j]] + c[None, :]], axis=1), need - 1, axis=1)[:, :need]
                self.reach = best.max(axis=1)

        def meet(self, number: int, key: int, load: Callable) -> None:
            j = int(np.searchsorted(cells, key))
            rows = np.flatnonzero(self.d[:, j] - radius[j] <= np.minimum(self.reach, self.bound) * (1 + 1e-9) + 1e-6)
            if len(rows):
                self.add(rows, *load())

    blocks = F.create_map(*[F.lit(x) for r in stats for x in (r["cell"], math.ceil(r["n"] / block_rows))])
    deal = [F.col("cell"), F.pmod(F.xxhash64("id"), blocks[F.col("cell")])]
    n_reps = reps.count()
    left = packed(reps.select("rep", "v"), asked, n_reps, left_rows(spark, n_reps, block_rows), [F.col("rep")])
    right = packed(placed.select("id", "v", "carried", "cell"), held, n_points, block_rows, deal, "cell")
    return met(left, right, Asking, _FOUND)


def _block_join(reps: DataFrame, t: DataFrame, need: int, block_rows: int) -> DataFrame:
    """`_pivot_join` for points of one cell, at most `block_rows` of them: nothing to prune, so every batch of queries meets them all."""
    rows = t.select("id", "v", "carried").collect()
    t_ids, t_rows = np.array([r["id"] for r in rows]), np.array([r["v"] for r in rows], dtype=float)
    carried = np.array([r["carried"] for r in rows], dtype=object)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                one = _Nearest(batch["rep"].to_numpy(), stacked(batch["v"]), need)
                one.add(np.arange(len(batch)), t_ids, t_rows, carried)
                yield one.result()

    return spread(reps.select("rep", "v"), "rep").mapInPandas(match, _FOUND)


def knn_classify(
    train: DataFrame,
    df: DataFrame,
    id_col: str,
    vector: str,
    label: str,
    classes: Sequence[str],
    k: int = 5,
    **options,
) -> DataFrame:
    """Append vote shares of the k nearest training rows as `probability`, and the `prediction`.

    A tie goes to the class listed first. A training row counts among its own neighbours. A row without a vector stays, with neither.
    """
    found = knn_join(df, train, id_col, vector, k, carry=label, **options)
    votes = found.groupBy("id").agg(
        F.array(*[F.count_if(F.col("carried") == c) / F.count(F.lit(1)) for c in classes]).alias(
            "probability"
        )
    )
    names = F.array(*[F.lit(c) for c in classes])
    best = F.array_position("probability", F.array_max("probability")).cast("int")
    scored = votes.withColumn("prediction", F.element_at(names, best)).withColumnRenamed("id", id_col)
    return df.join(scored, id_col, "left")


def approximate_similar_rows(
    df: DataFrame,
    id_col: str,
    vector: str,
    query_id,
    k: int = 10,
    bucket_length: float = 2.0,
    n_tables: int = 4,
    seed: int = 42,
) -> DataFrame:
    """(id, distance) of about the k nearest rows by cosine distance, from hashed buckets.

    Only rows that share a bucket with the query are measured, so some neighbours may be missed.
    """
    rows = _unit(df.select(ref(id_col).alias("id"), doubles(ref(vector)).alias("v")), "v")
    key = rows.where(F.col("id") == F.lit(query_id)).select(array_to_vector("v").alias("f")).first()
    if key is None:
        raise ValueError(f"no row with id {query_id!r}")
    others = rows.where(F.col("id") != F.lit(query_id)).select("id", array_to_vector("v").alias("features"))
    hashing = BucketedRandomProjectionLSH(
        inputCol="features",
        outputCol="hashes",
        bucketLength=bucket_length,
        numHashTables=n_tables,
        seed=seed,
    )
    found = hashing.fit(others).approxNearestNeighbors(others, key["f"], k, distCol="d")
    return found.select("id", F.round(F.col("d") * F.col("d") / 2, 6).alias("distance"))


def auto_cluster(
    df: DataFrame, id_col: str, k: int = 5, x: str = "x", y: str = "y", seed: int = 42
) -> DataFrame:
    """Append `cluster` (string) from k-means on the 2-D coordinates; unchanged below two clusters."""
    k = min(k, len(df.select(ref(id_col)).take(k)))
    if k < 2:
        return df
    points = VectorAssembler(inputCols=[x, y], outputCol="_xy").transform(df)
    model = KMeans(k=k, seed=seed, featuresCol="_xy", predictionCol="_cluster").fit(points)
    clustered = model.transform(points)
    return clustered.withColumn("cluster", F.col("_cluster").cast("string")).drop("_xy", "_cluster")
