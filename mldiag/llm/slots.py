"""Sharding by fixed virtual slots.

A record's hash puts it into one of a fixed number of slots for good. Bytes are added up per slot, and a versioned
table maps slots to shards; rebalancing and growing edit that table, never the records. An edit moves whole slots from the fullest
shard to the emptiest, and swaps slots where no move helps, until the shards' bytes can't be brought nearer.

The law is `bytes`: shards have nearly equal sizes. A slot is hashed from identifier and content, so that neither missing nor
repeated identifiers fill one slot. What comes to the driver is one row a slot. A record's place in its shard is its
rank within the slot behind the slots before it, so that no task sorts a whole shard.

Cases: a null text has one byte and the checksum of the empty text; null identifiers are hashed like any other; rows that repeat
share a slot and have places of their own. An empty table gives no rows; a text of any length is a size and a checksum; other columns
have no part in it, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mldiag.llm.common import new_path, stored, text_or_empty

SLOTS = 4096
SHARDS = 16


def first_map(slots: int, shards: int) -> np.ndarray:
    """Shard of each slot before anything is known: as many slots in each."""
    return np.arange(slots) * shards // slots


def rebalanced(shard_of: np.ndarray, load: np.ndarray, shards: int) -> np.ndarray:
    """The map after moves and swaps of slots between the fullest and the emptiest shard; `load` is bytes by slot."""
    shard_of = shard_of.copy()
    total = np.bincount(shard_of, weights=load, minlength=shards).astype(np.int64)
    open_ = np.ones(shards, bool)  # a full shard that no change helps (one huge slot, say) is left out from then on
    for _ in range(20 * len(load)):
        full, empty = int(np.where(open_, total, -1).argmax()), int(total.argmin())
        gap = int(total[full] - total[empty])
        if gap <= 1:
            break
        ours, theirs = np.flatnonzero((shard_of == full) & (load > 0)), np.flatnonzero((shard_of == empty) & (load > 0))
        # a change of d bytes leaves a gap of |gap - 2d|; moving gives a slot's load, swapping the difference of two
        options = [(abs(gap - 2 * int(load[s])), s, -1) for s in ours[np.argsort(np.abs(gap - 2 * load[ours]), kind="stable")[:1]].tolist()]
        if len(ours) and len(theirs):
            theirs = theirs[np.argsort(load[theirs], kind="stable")]
            near = np.searchsorted(load[theirs], load[ours] - gap / 2)
            for shift in (-1, 0):
                other = theirs[np.clip(near + shift, 0, len(theirs) - 1)]
                left = np.abs(gap - 2 * (load[ours] - load[other]))
                best = int(left.argmin())
                options.append((int(left[best]), int(ours[best]), int(other[best])))
        if not options or min(options)[0] >= gap:
            open_[full] = False
            continue
        _, give, take = min(options)
        shard_of[give] = empty
        moved = int(load[give])
        if take >= 0:
            shard_of[take] = full
            moved -= int(load[take])
        total[full] -= moved
        total[empty] += moved
    return shard_of


def grown(shard_of: np.ndarray, load: np.ndarray, shards: int) -> np.ndarray:
    """The map with one more shard, which takes slots from the fullest ones and gives none."""
    shard_of = shard_of.copy()
    total = np.bincount(shard_of, weights=load, minlength=shards + 1).astype(np.int64)
    goal = int(total.sum()) // (shards + 1)
    while total[shards] < goal:
        fits = (load > 0) & (load <= goal - total[shards]) & (shard_of != shards) & (total[shard_of] > goal)
        if not fits.any():
            break
        full = shard_of[fits][total[shard_of[fits]].argmax()]
        ours = np.flatnonzero(fits & (shard_of == full))
        slot = ours[load[ours].argmax()]
        shard_of[slot] = shards
        total[full] -= load[slot]
        total[shards] += load[slot]
    return shard_of


def write_map(spark: SparkSession, path: str, version: int, shard_of: np.ndarray) -> None:
    """Store one version; earlier ones stay."""
    rows = pd.DataFrame({"version": version, "virtual_slot": np.arange(len(shard_of)), "shard": shard_of.astype(np.int32)})
    spark.createDataFrame(rows, "version int, virtual_slot int, shard int").coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, the newest unless named."""
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("version")).first()[0] if version is None else version
    return rows.filter(F.col("version") == newest)


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every record."""
    text = text_or_empty()
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("bigint").alias("text_crc32"),
    )
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, law, shard, slot (place in the shard), grown_shard, virtual_slot, map_version.

    Version 0 of the map gives every shard as many slots; version 1 is edited after the bytes of the slots are known."""
    spark = docs.sparkSession
    path = path or new_path(spark, "slot-map")
    rows = stored(slotted(docs, slots), "slotted")
    load, count = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():  # one row a slot
        load[r.virtual_slot], count[r.virtual_slot] = r["size"], r.n
    start = first_map(slots, shards)
    write_map(spark, path, 0, start)
    write_map(spark, path, 1, rebalanced(start, load, shards))
    current = read_map(spark, path).toPandas().sort_values("virtual_slot", ignore_index=True)
    current["n"] = count[current.virtual_slot]
    current["before"] = current.groupby("shard").n.cumsum() - current.n
    table = spark.createDataFrame(current[["virtual_slot", "shard", "before", "version"]], "virtual_slot int, shard int, before bigint, map_version int")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    ranked = rows.withColumn("rank", place.cast("bigint"))
    return ranked.join(F.broadcast(table), "virtual_slot").select(  # a row a slot, a fixed number
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
