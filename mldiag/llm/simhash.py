"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The perfect binary Golay code [23, 12, 7] gives each segment the
indices of all code words within four bits: one index for most error patterns and six for the others. Two segments that
differ in at most two bits always share an index, since the vector half way between them lies within three bits of a code word.
Two fingerprints at two or fewer bits agree in at least one whole segment (pigeonhole) and share an index in each other one. So
a key is (which segment is free of errors, its bits, an index of the next segment), at most 18 keys a fingerprint, and every link
meets under some key. Fingerprints that meet are verified by their distance.

Equal fingerprints collapse to one before the join. Within a key no pairs are listed: small keys compare all with all in numpy
blocks, large ones look up each fingerprint's neighbours among the sorted members, and either way only a link to the smallest
member of each local component leaves the task. A key's members lie within four bits of one code word, so it can't hold
more than 10,903 values of the next segment; keys with many members are split by the indices of the third segment.

Cases: a null or empty text has fingerprint zero and is linked like any other; a text of one or two words is one shingle.
Repeated rows share a fingerprint; a null doc_id names no component that has another. A very long text is hashed in batches of
shingles. An empty table gives no rows. Only doc_id and text are read; `deduplicate` keeps all columns, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mldiag.llm.common import bytes_of, map_batches, stored

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: The generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, and its length.
GOLAY_POLYNOMIAL = 0b101011100011
GOLAY_BITS = 23
#: Segments of a fingerprint as (lowest bit, bits).
SEGMENTS = ((0, 23), (23, 23), (46, 18))
COMPARE_ALL = 1_000
SPLIT_KEY = 50_000
BATCH = 20_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(content: bytes, width: int = SHINGLE) -> int:
    """SimHash of a text: bit b is set if more than half of the shingle hashes have it."""
    import xxhash

    words = content.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    counts, total = np.zeros(64, np.int64), len(starts)
    stops = ends[width - 1 :].tolist()
    for at in range(0, total, BATCH):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + BATCH], stops[at : at + BATCH])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > total).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): one row per input row, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in bytes_of(batch.column(1))], np.uint64)
            columns = [batch.column(0), batch.column(2), pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp"])

    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return map_batches(texts, run, "doc_id bigint, text_hash bigint, fp bigint")


def golay_indices() -> tuple[np.ndarray, np.ndarray]:
    """For each 11-bit syndrome: the error patterns of up to four bits that give it, and how many there are (1 or 6).

    A code word's first twelve bits are its index, so a vector's indices are those of the vector without each error pattern."""
    syndromes = np.zeros(GOLAY_BITS, np.int64)
    for bit in range(GOLAY_BITS):
        rest = 1 << bit
        for high in range(GOLAY_BITS - 1, 10, -1):
            if rest >> high & 1:
                rest ^= GOLAY_POLYNOMIAL << (high - 11)
        syndromes[bit] = rest
    patterns: list[list[int]] = [[] for _ in range(1 << 11)]
    for size in range(5):
        for bits in combinations(range(GOLAY_BITS), size):
            syndrome = 0
            for b in bits:
                syndrome ^= int(syndromes[b])
            patterns[syndrome].append(sum(1 << b for b in bits))
    most = max(map(len, patterns))
    table = np.zeros((1 << 11, most), np.int64)
    for s, found in enumerate(patterns):
        table[s, : len(found)] = found
    return table, np.array([len(p) for p in patterns], np.int64)


def syndromes_of(vectors: np.ndarray) -> np.ndarray:
    rest = vectors.astype(np.int64).copy()
    for high in range(GOLAY_BITS - 1, 10, -1):
        rest ^= np.where(rest >> high & 1, GOLAY_POLYNOMIAL << (high - 11), 0)
    return rest


def code_indices(vectors: np.ndarray, table: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the vector, index) for every code word within four bits of each 23-bit vector."""
    syndromes = syndromes_of(vectors)
    n = sizes[syndromes]
    rows = np.repeat(np.arange(len(vectors)), n)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    words = vectors[rows].astype(np.int64) ^ table[syndromes[rows], nth]
    return rows, words >> 11


def _segment(values: np.ndarray, which: int) -> np.ndarray:
    low, bits = SEGMENTS[which]
    return (values >> np.uint64(low)).astype(np.uint64) & np.uint64((1 << bits) - 1)


def _keys(table: np.ndarray, sizes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(0)).view(np.uint64)
            for exact in range(3):
                rows, index = code_indices(_segment(values, (exact + 1) % 3), table, sizes)
                key = (np.int64(exact) << 36) | (_segment(values, exact).astype(np.int64)[rows] << 12) | index
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(values.view(np.int64)[rows])], ["key", "fp"])

    return run


def local_links(members: np.ndarray, exact: int, table: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member linked to it through members of this key), for the members that aren't the smallest themselves."""
    from_, to = _star(members, exact) if len(members) <= SPLIT_KEY else (None, None)
    if from_ is not None:
        return from_, to
    third = _segment(members, (exact + 2) % 3)
    rows, index = code_indices(third, table, sizes)
    order = np.argsort(index, kind="stable")
    rows, cuts = rows[order], np.flatnonzero(np.diff(index[order])) + 1
    parts = [_star(members[part], exact) for part in np.split(rows, cuts) if len(part) > 1]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _star(members: np.ndarray, exact: int) -> tuple[np.ndarray, np.ndarray]:
    members = np.unique(members)
    label = np.arange(len(members))
    if len(members) <= COMPARE_ALL:
        near = np.bitwise_count(members[:, None] ^ members[None, :]) <= DISTANCE
        while True:
            new = np.where(near, label[None, :], len(members)).min(axis=1)
            new = new[new]
            if (new == label).all():
                break
            label = new
    else:
        low, bits = SEGMENTS[exact]
        free = [b for b in range(64) if not low <= b < low + bits]
        flips = [1 << a for a in free] + [1 << a | 1 << b for a, b in combinations(free, 2)]
        pairs = []
        for flip in flips:
            other = members ^ np.uint64(flip)
            at = np.minimum(np.searchsorted(members, other), len(members) - 1)
            hit = np.flatnonzero(members[at] == other)
            pairs.append((hit, at[hit]))
        while True:
            new = label.copy()
            for a, b in pairs:
                np.minimum.at(new, a, label[b])
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
    moved = np.flatnonzero(label != np.arange(len(members)))
    return members[moved], members[label[moved]]


def _links(table: np.ndarray, sizes: np.ndarray):
    """Input sorted by key; a key may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried_key: np.ndarray = np.zeros(0, np.int64)
        carried: list[np.ndarray] = []

        def links(key: np.ndarray, members: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, len(key))
            several = np.flatnonzero(ends - starts > 1)
            out = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
            two = several[ends[several] - starts[several] == 2]
            a, b = members[starts[two]], members[starts[two] + 1]
            near = (np.bitwise_count(a ^ b) <= DISTANCE) & (a != b)
            out.append((np.maximum(a, b)[near], np.minimum(a, b)[near]))
            for i in several[ends[several] - starts[several] > 2].tolist():
                out.append(local_links(members[starts[i] : ends[i]], int(key[starts[i]] >> 36), table, sizes))
            a, b = (np.concatenate([o[i] for o in out]).view(np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            key = np.asarray(batch.column(0))
            members = np.asarray(batch.column(1)).view(np.uint64)
            if len(key) == 0:
                continue
            if len(carried_key) and key[0] != carried_key[-1]:
                yield links(carried_key, np.concatenate(carried))
                carried_key, carried = carried_key[:0], []
            last = int(np.searchsorted(key, key[-1]))  # rows of the last key wait for the next batch
            carried.append(members[:last])
            carried_key = np.append(carried_key, key[:last])
            if last:
                yield links(carried_key, np.concatenate(carried))
                carried_key, carried = carried_key[:0], []
            carried.append(members[last:])
            carried_key = np.append(carried_key, key[last:])
        if len(carried_key):
            yield links(carried_key, np.concatenate(carried))

    return run


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b) with a > b as unsigned: enough links between the given distinct fingerprints to join all that are linked."""
    table, sizes = golay_indices()
    keyed = map_batches(distinct.select("fp"), _keys(table, sizes), "key bigint, fp bigint")
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    return map_batches(dealt, _links(table, sizes), "a bigint, b bigint").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): the smallest node each node of `edges` (a, b) is linked to, by alternating star contractions.

    Each round points every node at the smallest node among its neighbours and itself (large star: larger neighbours only; small
    star: smaller ones), which keeps the components and ends in stars. Rounds are written to the shared folder."""
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), label)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = large.distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        new = stored(small.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct(), label)
        # done when no node points at two, and none that is pointed at points on
        state = new.groupBy("a").agg(F.count("*").alias("n"))
        done = state.filter("n > 1").limit(1).count() == 0 and new.join(new.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() == 0
        edges = new
        if done:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def named_components(rows: DataFrame, links: DataFrame) -> DataFrame:
    """`rows` (doc_id, text_hash, fp) with component_id, the smallest doc_id of the rows whose fp is linked to the row's."""
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links)
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    shared = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(shared, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, component_id): component_id is the smallest doc_id linked to the row's, null where none has an id."""
    rows = stored(fingerprints(docs), "fingerprints")
    return named_components(rows, fingerprint_links(rows.select("fp").distinct()))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, fingerprint as 16 hex digits, component_id."""
    found = near_components(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_least(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of their component in `found` (doc_id, text_hash, component_id).

    Rows of one doc_id in one component are one document and share its fate; rows without an id go where a row with one stays."""
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_hash").distinct()
    same = docs["doc_id"].cast("bigint").eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["text_hash"])
    return docs.join(gone, same, "left_anti")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows whose doc_id is the smallest of their component, with the columns of the input."""
    return keep_least(docs, near_components(docs))
