"""Merkle manifest of a dataset, with nested-interval labels.

Every row is a leaf: the SHA-256 of its fields. The leaves of a group stand in order of their identifiers; the roots of the groups
are the leaves of one tree above them. A node is labelled by the interval (lo, hi) of leaf ranks that it covers, so that ancestry is
containment of intervals, and what a parent's interval has beside a node's own is where its siblings lie.

Levels are taken `LEVELS` at a time. The nodes of such a bucket of levels below one node of the bucket's top level are one row, 31 nodes at
most; a leaf meets its ancestors by one equal join a bucket, on the interval that the row covers, and containment picks them
inside it. Rounds go up by factors of 16, so a group of a billion leaves takes eight, each over a sixteenth of the rows before. Ranks
come from a range shuffle and row numbers of each partition: no task sees a whole group.

Cases: a null field enters as `-`, an empty one as `0:`; null identifiers come first, equal ones stand in order of their leaves, and
repeated rows have leaves of their own. A null group comes first. Very long texts are hashed by the JVM as they are. An empty table has no rows in any
result. Only the named fields are read; other columns, whatever they are called, have no part in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mldiag.llm.common import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 4
STEPS = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """`rows` with `lo`, the 0-based place of a row in its `key` by `order`, and `n`, the rows of the key."""
    cut = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    cut = stored(cut.withColumn("at", F.monotonically_increasing_id()), "ranks").withColumn("part", F.shiftright("at", 33))
    parts = cut.groupBy("key", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    whole = Window.partitionBy("key")  # a row for each partition that holds the key
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n"))
    joined = cut.join(parts, ["key", "part"])
    return joined.withColumn("lo", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def _above(below: str, level: int) -> Column:
    """The nodes over those of column `below`, two by two, while the group has more than one node."""

    def node(i: Column) -> Column:
        left, right = F.get(F.col(below), 2 * i), F.get(F.col(below), 2 * i + 1)
        digest = F.sha2(F.concat(left["digest"], F.coalesce(right["digest"], F.lit(""))), 256)
        return F.struct(F.lit(level).alias("level"), left["lo"].alias("lo"), F.coalesce(right["hi"], left["hi"]).alias("hi"), digest.alias("digest"))

    last = F.floor((F.size(below) + 1) / 2).cast("int") - 1
    return F.when(F.col("n") > 1 << (level - 1), F.transform(F.sequence(F.lit(0), last), node))


def buckets(leaves: DataFrame) -> list[DataFrame]:
    """For each bucket of levels a stored table (key, block, n, nodes, top): `nodes` are those of levels LEVELS * b to
    LEVELS * (b + 1) below the node that covers the ranks block * 16^(b + 1) and on, (level, lo, hi, digest) each; `top` is that node."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    out: list[DataFrame] = []
    nodes = leaves.select("key", "n", "lo", F.col("lo").alias("hi"), "digest")
    while not out or 1 << LEVELS * len(out) < most:
        base = LEVELS * len(out)
        kids = F.struct(F.lit(base).alias("level"), "lo", "hi", "digest")
        rows = nodes.groupBy("key", "n", F.shiftright("lo", base + LEVELS).alias("block")).agg(F.sort_array(F.collect_list(kids)).alias("l0"))
        for i in range(LEVELS):
            rows = rows.withColumn(f"l{i + 1}", _above(f"l{i}", base + i + 1))
        levels = [F.col(f"l{i}") for i in range(LEVELS + 1)]
        every = F.flatten(F.filter(F.array(*levels), lambda x: x.isNotNull()))
        rows = rows.select("key", "block", "n", every.alias("nodes")).withColumn("top", F.element_at("nodes", -1))
        out.append(stored(rows, "intervals"))
        nodes = out[-1].filter(F.col("n") > F.lit(1 << (base + LEVELS))).select("key", "n", "top.lo", "top.hi", "top.digest")
    return out


def nodes(tables: Sequence[DataFrame]) -> DataFrame:
    """(key, level, lo, hi, digest) of every node, the manifest itself."""
    parts = []
    for b, table in enumerate(tables):
        node = F.explode("nodes").alias("node")
        # the top level of a bucket is the lowest of the next, where the group goes on
        part = table.select("key", "n", node).filter((F.col("node.level") < LEVELS * (b + 1)) | (F.col("n") <= F.lit(1 << LEVELS * (b + 1))))
        parts.append(part.select("key", "node.level", "node.lo", "node.hi", "node.digest"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def roots(tables: Sequence[DataFrame]) -> DataFrame:
    """(key, root) of every group."""
    whole = [t.filter((F.col("block") == 0) & (F.col("n") <= F.lit(1 << LEVELS * (b + 1)))) for b, t in enumerate(tables)]
    whole = [t.filter(F.col("n") > F.lit(1 << LEVELS * b)) if b else t for b, t in enumerate(whole)]
    out = whole[0]
    for part in whole[1:]:
        out = out.unionByName(part)
    return out.select("key", F.col("top.digest").alias("root"))


def _steps() -> Column:
    """The steps from the node (lo, hi) to the top of its row: the digests left and right of each ancestor inside its parent."""
    lines = F.filter("nodes", lambda x: (x["lo"] <= F.col("lo")) & (x["hi"] >= F.col("hi")))

    def between(level: Column, low: Column, high: Column) -> Column:
        return F.get(F.filter("nodes", lambda x: (x["level"] == level) & (x["lo"] == low) & (x["hi"] == high)), F.lit(0))["digest"]

    def step(i: Column) -> Column:
        own, parent = F.get(F.col("line"), i), F.get(F.col("line"), i + 1)
        left = between(own["level"], parent["lo"], own["lo"] - 1)
        right = between(own["level"], own["hi"] + 1, parent["hi"])
        return F.struct(left.alias("left"), right.alias("right"))

    inside = F.when(F.size("line") > 1, F.transform(F.sequence(F.lit(0), F.size("line") - 2), step))
    return lines, F.coalesce(inside, F.array().cast(STEPS))


def paths(leaves: DataFrame, tables: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """`leaves` with `steps`, the siblings of all ancestors from the leaf up, and the columns of `above`, a table (key, steps, ...) that
    says how each group's root goes on."""
    extra = [c for c in above.columns if c not in ("key", "steps")]
    on = above.withColumnRenamed("steps", "rest")
    line, steps = _steps()
    higher = None
    for b in reversed(range(len(tables))):
        table = tables[b].select("key", "block", "nodes", "n")
        ends = table.filter(F.col("n") <= F.lit(1 << LEVELS * (b + 1))).drop("n").join(on, "key")
        if higher is not None:
            goes_on = table.drop("n").join(higher, ["key", "block"])
            ends = ends.unionByName(goes_on.select(ends.columns))
        items = leaves if b == 0 else tables[b - 1].filter(F.col("n") > F.lit(1 << LEVELS * b)).select("key", F.col("block").alias("below"), "top.lo", "top.hi")
        hi = [] if b else [F.col("lo").alias("hi")]
        items = items.select("*", *hi, F.shiftright("lo", LEVELS * (b + 1)).alias("block"))
        found = items.join(ends, ["key", "block"]).withColumn("line", line).withColumn("steps", F.concat(steps, "rest"))
        if b == 0:
            return found.select(*leaves.columns, "steps", *extra)
        higher = stored(found.select("key", F.col("below").alias("block"), F.col("steps").alias("rest"), *extra), "paths")
    raise AssertionError


def fold(start: Column, steps: Column | str) -> Column:
    """The root that a leaf and its siblings give."""

    def up(digest: Column, s: Column) -> Column:
        return F.sha2(F.concat(F.coalesce(s["left"], F.lit("")), digest, F.coalesce(s["right"], F.lit(""))), 256)

    return F.aggregate(steps, start, up)


def proof_digest(steps: Column | str) -> Column:
    beside = F.transform(steps, lambda s: F.concat(F.coalesce(s["left"], F.lit("")), F.coalesce(s["right"], F.lit(""))))
    return F.sha2(F.array_join(beside, ""), 256)


def prove(rows: DataFrame) -> DataFrame:
    """`rows` (key, doc_id, digest, ...) as leaves, with lo, n, `subroot` (of the row's key), `root` and `steps`."""
    leaves = stored(ranked(rows, ["doc_id", "digest"]), "leaves")
    tables = buckets(leaves)
    subroots = roots(tables).select(F.lit("").alias("key"), F.col("key").alias("name"), F.col("root").alias("digest"))
    tops = stored(ranked(subroots, ["name"]), "subroots")
    over = buckets(tops)
    end = roots(over).select("key", F.array().cast(STEPS).alias("steps"), "root")
    above = paths(tops, over, end).select(F.col("name").alias("key"), "steps", F.col("digest").alias("subroot"), "root")
    return paths(leaves, tables, stored(above, "above"))


def leaf_rows(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(key, doc_id, digest, altered): the leaf of each row, and the leaf with n_chars one more where `tampered` is true."""
    values = {c: F.col(c) for c in FIELDS}
    change = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    grown = values | {"n_chars": F.when(change, F.col("n_chars").cast("bigint") + 1).otherwise(F.col("n_chars").cast("bigint"))}
    key = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    altered = F.when(change, leaf(list(grown.values())))
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf(list(values.values())).alias("digest"), altered.alias("altered"))
    return rows.withColumn("altered", F.coalesce("altered", "digest"))


def tampering(every: int = 7) -> Column:
    return F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % every == 0


def audit(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root (of the row as it is now), verified."""
    found = prove(leaf_rows(docs, tampered))
    out = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest("steps").alias("proof_sha256"), fold(F.col("altered"), "steps").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
