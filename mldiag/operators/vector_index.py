"""Inverted-file index of vectors as a table: cells about centroids, residual codes of a byte a dimension, exact re-ranking.

Centroids are fitted on a bounded hashed sample; every row is then assigned to its nearest one and written by cell with its residual in
one byte a dimension and with its vector. A batch of queries probes the nearest cells of each: queries and rows of a cell meet in parts (a cell that
holds a third of all rows is split), codes give the nearest `candidates` of each part, and the best of all parts are measured exactly.
More probes or candidates give more recall; all cells and all candidates are an exact search.

Cases: rows without a vector are not in the index and have no answers as queries; copies tie by id; an empty table is an empty index;
fewer rows than neighbours asked for are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mldiag.functions.columns import doubles, euclidean, ref
from mldiag.operators.neighbors import _unit
from mldiag.operators.scale import hash_sample
from mldiag.session import cut_lineage

#: Rows that the centroids are fitted on, at most.
SAMPLE = 100_000
#: Rows of a cell that meet in a task.
PART_ROWS = 8_192
MAX_CELLS = 4_096


def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centres of each row, nearest first."""
    d = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def build(df: DataFrame, id_col: str, vector: str, path: str, metric: str = "euclidean", n_cells: int | None = None, seed: int = 42) -> None:
    """Write the index of all rows: `path`/centres (cell, centre, scale) and `path`/rows (cell, part, id, codes, v)."""
    spark = df.sparkSession
    rows = df.select(ref(id_col).alias("id"), doubles(ref(vector)).alias("v")).where(F.col("v").isNotNull())
    rows = cut_lineage(_unit(rows, "v") if metric == "cosine" else rows)
    n = rows.count()
    n_cells = min(MAX_CELLS, n_cells or max(1, round(2 * n**0.5)))
    sample = hash_sample(rows, "id", SAMPLE, seed).select(array_to_vector("v").alias("features"))
    if n > n_cells > 1:
        centres = np.array(KMeans(k=n_cells, seed=seed, maxIter=10).fit(sample).clusterCenters())
    else:
        centres = np.array([r["v"] for r in hash_sample(rows, "id", max(1, n_cells), seed).collect()], dtype=float)
    kind = rows.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy()).astype(float)
                cell = _nearest(x, centres, 1)[:, 0]
                rest = x - centres[cell]
                yield batch.assign(cell=cell, reach=np.abs(rest).max(1))

    placed = cut_lineage(rows.mapInPandas(assign, f"id {kind}, v array<double>, cell int, reach double"))
    sizes = {r["cell"]: (r["n"], r["reach"]) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach")).collect()}
    scale = np.array([max(sizes.get(c, (0, 0.0))[1] / 127, 1e-300) for c in range(len(centres))])
    parts = {c: -(-m // PART_ROWS) for c, (m, _) in sizes.items()}

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell = batch["cell"].to_numpy()
                rest = np.stack(batch["v"].to_numpy()).astype(float) - centres[cell]
                codes = np.rint(rest / scale[cell][:, None]).astype(np.int8)
                yield batch.drop(columns="reach").assign(codes=[c.tobytes() for c in codes])

    table = spark.createDataFrame([(c, centres[c].tolist(), float(scale[c]), parts.get(c, 0)) for c in range(len(centres))], "cell int, centre array<double>, scale double, parts int")
    table.write.parquet(f"{path}/centres")
    coded = placed.mapInPandas(code, f"id {kind}, v array<double>, cell int, codes binary")
    split = F.pmod(F.xxhash64("id"), F.greatest(F.col("parts"), F.lit(1))).cast("int")
    dealt = coded.join(F.broadcast(table.select("cell", "parts")), "cell").withColumn("part", split).drop("parts")  # at most MAX_CELLS rows
    dealt.repartition("cell", "part").sortWithinPartitions("cell", "part").write.parquet(f"{path}/rows")


def search(spark: SparkSession, path: str, queries: DataFrame, id_col: str, vector: str, k: int = 10, probes: int = 8,
           candidates: int | None = None, metric: str = "euclidean", exclude_self: bool = False) -> DataFrame:
    """(id, rank, neighbor, distance) of about the k nearest index rows of every query row; the distances are exact."""
    rows = spark.read.parquet(f"{path}/rows")
    table = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    q = queries.select(ref(id_col).alias("id"), doubles(ref(vector)).alias("v")).where(F.col("v").isNotNull())
    q = _unit(q, "v") if metric == "cosine" else q
    kind, other = (x.schema["id"].dataType.simpleString() for x in (q, rows))
    result = f"id {kind}, rank int, neighbor {other}, distance double"
    if not table:
        return spark.createDataFrame([], result)
    centres, scale = np.array([r["centre"] for r in table]), np.array([r["scale"] for r in table])
    parts = F.array(*[F.lit(r["parts"]) for r in table])
    take = max(4 * k, 40) if candidates is None else candidates

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = _nearest(np.stack(batch["v"].to_numpy()).astype(float), centres, probes)
                yield pd.DataFrame({"q": batch["id"].to_numpy(), "qv": batch["v"].to_numpy(), "cells": near.tolist()})

    asked = q.mapInPandas(probe, f"q {kind}, qv array<double>, cells array<int>")
    asked = asked.select("q", "qv", F.explode("cells").alias("c")).where(F.get(parts, F.col("c")) > 0)
    asked = asked.withColumn("p", F.explode(F.sequence(F.lit(0), F.get(parts, F.col("c")) - 1)))

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "neighbor": [], "about": []})
        cell = int(left["c"].iloc[0])
        ids = right["id"].to_numpy()
        codes = np.frombuffer(b"".join(right["codes"]), np.int8).reshape(len(right), -1).astype(np.float32) * np.float32(scale[cell])
        lengths = (codes * codes).sum(1)
        out = []
        for at in range(0, len(left), 512):
            part = left.iloc[at : at + 512]
            rest = (np.stack(part["qv"].to_numpy()).astype(float) - centres[cell]).astype(np.float32)
            d = lengths[None, :] - 2 * rest @ codes.T + (rest * rest).sum(1)[:, None]
            best = np.argpartition(d, min(take, d.shape[1]) - 1, axis=1)[:, :take]
            size = best.shape[1]
            out.append(pd.DataFrame({"q": np.repeat(part["q"].to_numpy(), size), "neighbor": ids[best.ravel()], "about": np.take_along_axis(d, best, 1).ravel()}))
        return pd.concat(out)

    found = asked.groupBy("c", "p").cogroup(rows.select("cell", "part", "id", "codes").groupBy("cell", "part")).applyInPandas(match, f"q {kind}, neighbor {other}, about double")
    if exclude_self:
        found = found.where(F.col("q") != F.col("neighbor"))
    # a query has probes x candidates rows for each part of a cell
    first = Window.partitionBy("q").orderBy("about", "neighbor")
    kept = found.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= take).select("q", "neighbor")
    exact = kept.join(rows.select(F.col("id").alias("neighbor"), F.col("v").alias("nv")), "neighbor")
    exact = exact.join(q.select(F.col("id").alias("q"), F.col("v").alias("qv")), "q")
    distance = euclidean(F.col("qv"), F.col("nv"))
    distance = distance * distance / 2 if metric == "cosine" else distance
    exact = exact.select("q", "neighbor", distance.alias("distance"))
    last = Window.partitionBy("q").orderBy("distance", "neighbor")
    return exact.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select(F.col("q").alias("id"), "rank", "neighbor", "distance")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, answers, and the share of the exact neighbours (id, neighbor) that were found."""
    hit = found.select("id", "neighbor", F.lit(1).alias("hit"))
    both = exact.select("id", "neighbor").join(hit, ["id", "neighbor"], "left")
    return both.agg(F.count_distinct("id").alias("queries"), F.count(F.lit(1)).alias("answers"), (F.sum("hit") / F.count(F.lit(1))).alias("recall"))
