"""Mixing sources to target weights by subset-sum budget fitting.

Sources share a budget by weight; no target exceeds a given multiple of its source, and what is cut off is shared again by weight. A
source takes all its documents as often as its target holds them whole. The rest is fitted exactly: documents are counted by
length, each length gives its proportional part, the longest lengths fill what is left down to a window, and a bounded-knapsack
dynamic programme over the window finds the counts whose lengths add up to it. Each length then gives so many documents, the
first in the order of a seeded hash.

What grows with the rows stays in Spark: counts by (source, length, slice of the hash), and the choice of documents by a row number
within such slices, so that neither a hot source nor a million copies of one length meet in one task. A source's table of
lengths (one row a length, bounded by the longest document) is fitted in one task.

Cases: a null source is a source, the last one; a null or empty text has size 0 and takes nothing; rows that repeat are rows
of their own. The choice depends on the seed and the identifiers alone.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mldiag.llm.common import free_name, stored, text_or_empty

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SEED = 17
SLICES = 256
WINDOW = 1 << 16
OVER = 1 << 10
WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(key, source_size, target) of the sources in code point order, null last; `sizes` has key, source and source_size.

    Capped sources are those whose cap a unit of weight is below the level that the others reach: with sources in ascending
    order of cap over weight, the level at each is what the budget leaves after all smaller caps, a unit of remaining weight."""
    names = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sizes.withColumn("weight", F.element_at(cycle, F.pmod(F.row_number().over(names) - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("heavy", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("heavy"))
        .withColumn("capped", F.col("level") >= F.col("cap") / F.col("weight"))
    )
    level = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight"))
    return ranked.select("key", "source_size", target.alias("target"))


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, goal: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take, so that the lengths add up to `goal` or as near to it as any sum that holds the proportional part."""
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if goal <= 0 or total == 0:
        return taken
    if goal >= total:
        return counts.copy()
    part = np.array([int(c) * goal // total for c in counts.tolist()], np.int64)
    taken, miss = _filled(lengths, counts, part, goal, window, OVER)
    step = int(np.gcd.reduce(lengths))
    if miss > min(goal % step, -goal % step):  # few documents are left: none too long to be looked at, and any sum that is nearer
        wide, nearer = _filled(lengths, counts, part, goal, max(window, 3 * int(lengths.max())), miss)
        taken = wide if nearer < miss else taken
    return taken


def _filled(lengths: np.ndarray, counts: np.ndarray, part: np.ndarray, goal: int, window: int, over: int) -> tuple[np.ndarray, int]:
    """The counts that begin with `part`, and how far from the goal they end; sums up to `over` above the goal are looked at."""
    taken = part.copy()
    left = goal - int((lengths * taken).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order[lengths[order] > 0].tolist():
        more = min(int(counts[i] - taken[i]), max(0, left - window) // int(lengths[i]))
        taken[i] += more
        left -= more * int(lengths[i])
    # bounded knapsack over what is left; a length's count is cut into powers of two
    most = left + over
    first = np.full(most + 1, -1, np.int64)
    reach = np.zeros(most + 1, bool)
    reach[0] = True
    items: list[tuple[int, int]] = []
    for i in order.tolist():
        length, rest, part = int(lengths[i]), int(counts[i] - taken[i]), 1
        rest = min(rest, most // length) if length else 0
        while rest and not reach[left]:
            part = min(part, rest)
            weight = part * length
            new = np.flatnonzero(reach[: most + 1 - weight] & ~reach[weight:]) + weight
            first[new] = len(items)
            reach[new] = True
            items.append((i, part))
            rest -= part
            part *= 2
        if reach[left]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.abs(sums - left).argmin()])
    miss = abs(at - left)
    while at:
        i, part = items[first[at]]
        taken[i] += part
        at -= part * int(lengths[i])
    return taken, miss


def _fitted(window: int):
    def run(lengths: pd.DataFrame) -> pd.DataFrame:
        lengths = lengths.sort_values("size", ignore_index=True)
        total, target = int(lengths.source_size[0]), float(lengths.target[0])
        copies = int(target // total) if total else 0
        goal = int(round(target - copies * total))
        take = fit_lengths(lengths["size"].to_numpy(), lengths.n.to_numpy(), goal, window)
        return pd.DataFrame({"key": lengths.key, "size": lengths["size"], "copies": copies, "take": take})

    return run


def mixed(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = SEED,
    window: int = WINDOW,
) -> tuple[DataFrame, list[str]]:
    """The rows of `docs` with size, source_size, target and copies; returns the names that these four columns got."""
    size, source_size, target, copies, key, slice_, code, rank, take = names = [
        free_name(docs, n) for n in ("size", "source_size", "target", "copies", "mix_key", "mix_slice", "mix_code", "mix_rank", "mix_take")
    ]
    # a key that is never null: the source after an equals sign, or nothing
    rows = docs.withColumn(key, F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    rows = rows.withColumn(size, F.regexp_count(text_or_empty(), F.lit(WORDS)).cast("bigint"))
    rows = rows.withColumn(code, F.xxhash64(F.lit(seed), F.col("doc_id").cast("bigint")))
    rows = rows.withColumn(slice_, F.pmod(F.col(code), F.lit(SLICES)))
    plain = (F.col(key).alias("key"), F.col(size).alias("size"), F.col(slice_).alias("slice"), F.col("source").cast("string").alias("source"))
    slices = stored(rows.select(*plain).groupBy("key", "size", "slice").agg(F.count("*").alias("n"), F.max("source").alias("source")), "lengths")
    sizes = slices.groupBy("key").agg(F.max("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    lengths = slices.groupBy("key", "size").agg(F.sum("n").alias("n")).join(targets, "key")
    fitted = lengths.groupBy("key").applyInPandas(_fitted(window), "key string, size bigint, copies bigint, take bigint")
    before = Window.partitionBy("key", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counted = slices.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    plan = counted.join(fitted, ["key", "size"]).join(targets, "key")
    plan = plan.select(
        F.col("key").alias(key), F.col("size").alias(size), F.col("slice").alias(slice_), F.col("source_size").alias(source_size),
        F.col("target").alias(target), F.col("copies").alias(copies), (F.col("take") - F.col("before")).alias(take),
    )
    plan = stored(plan, "mix")
    # rows are dealt out once, by slice: the row number and the join use the same keys
    ordered = Window.partitionBy(key, size, slice_).orderBy(code, "doc_id", F.xxhash64(text_or_empty()))
    ranked = rows.withColumn(rank, F.row_number().over(ordered))
    joined = ranked.join(plan, [key, size, slice_])
    chosen = joined.withColumn(copies, F.col(copies) + (F.col(rank) <= F.col(take)).cast("bigint"))
    return chosen.select(*docs.columns, *names[:4]), names[:4]


def mix_table(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken."""
    narrow = docs.select("doc_id", "source", "text")
    rows, _ = mixed(narrow, **options)
    return rows.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with the columns of the input; a document taken twice is there twice."""
    rows, (_, _, _, copies) = mixed(docs, **options)
    return rows.withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).select(docs.columns)
