"""Every block of rows against every other, without a copy of the rows for each pair.

A shuffle that brings all pairs of blocks together writes each row once for every block of the other side. Here both sides are packed into
blocks that are kept once, and a task reads the right blocks past its left ones: memory is that of two blocks and of what the left one has found.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mldiag.session import cut_lineage

#: Left rows at most that are held against a right block at once.
CHUNK = 512


def packed(df: DataFrame, form: Callable[[pd.DataFrame], object], n: int, block_rows: int, deal: list[Column], key: str | None = None) -> DataFrame:
    """(number, key, payload): about n rows as blocks of at most `block_rows`, each of one value of `key` (an int column).

    `form` turns a frame of rows into what the block holds; `deal` spreads the rows over tasks.
    """
    parts = max(1, math.ceil(n / block_rows))
    dealt = df.repartition(parts, *deal)
    if key is not None:
        dealt = dealt.sortWithinPartitions(key)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, rows, of = TaskContext.get().partitionId(), [], 0, 0

        def block() -> pd.DataFrame:
            nonlocal number, held, rows
            frame = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
            out = pd.DataFrame({"number": [number], "key": [of], "payload": [pickle.dumps(form(frame), 5)]})
            number, held, rows = number + parts, [], 0
            return out

        for batch in batches:
            kinds = np.zeros(len(batch), int) if key is None else batch[key].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(batch)]
            for start, stop in zip(edges, edges[1:]):
                while start < stop:
                    if held and (rows == block_rows or kinds[start] != of):
                        yield block()
                    take = min(stop - start, block_rows - rows)
                    held.append(batch.iloc[start : start + take])
                    of, rows, start = int(kinds[start]), rows + take, start + take
        if held:
            yield block()

    return cut_lineage(dealt.mapInPandas(pack, "number bigint, key int, payload binary"))


def met(left: DataFrame, right: DataFrame, start: Callable, schema: str) -> DataFrame:
    """Rows that `start(number, payload)` returns as a frame by its `result()`, after its `meet(number, key, load)` was called for every right block.

    `load()` unpacks the right block. The right side is one partition that is read lazily, again for each left block, so nothing is shuffled.
    """

    def run(pairs: Iterator[tuple]) -> Iterator[tuple[bytes]]:
        held = {}
        for a, b in pairs:
            if a["number"] not in held:
                held[a["number"]] = start(a["number"], pickle.loads(a["payload"]))
            held[a["number"]].meet(b["number"], b["key"], lambda b=b: pickle.loads(b["payload"]))
        for one in held.values():
            yield (pickle.dumps(one.result(), 5),)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for payload in batch["payload"]:
                yield pickle.loads(payload)

    every = left.rdd.cartesian(right.rdd.coalesce(1)).mapPartitions(run)
    return left.sparkSession.createDataFrame(every, "payload binary").mapInPandas(rows, schema)


def left_rows(spark: SparkSession, n: int, block_rows: int) -> int:
    """Rows of a left block: fewer where full ones would leave tasks without work."""
    return max(1, min(block_rows, max(256, math.ceil(n / (4 * spark.sparkContext.defaultParallelism)))))


def stacked(column: pd.Series) -> np.ndarray:
    """Arrays of one length as a matrix."""
    return np.stack(column.to_numpy()).astype(float)


def squares(q: np.ndarray, t: np.ndarray, kind: type = float) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and by row how far rounding may move them."""
    qq, tt = (q * q).sum(1), (t * t).sum(1)
    left, right = np.column_stack([q, qq, np.ones(len(q))]).astype(kind), np.column_stack([-2.0 * t, np.ones(len(t)), tt]).astype(kind)
    return left @ right.T, 2 * (q.shape[1] + 8) * float(np.finfo(kind).eps) * (qq + tt.max())


def away(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Distances of paired rows by direct differences."""
    return np.concatenate([np.sqrt(((t[i : i + 65536] - q[i : i + 65536]) ** 2).sum(1)) for i in range(0, max(1, len(q)), 65536)])
