"""Near copies by the Jaccard similarity of word shingles: Golay-code indices of SimHash segments find candidates, exact sets decide.

A text is the set of its shingles of `WIDTH` lower-case words. Its SimHash has `BANDS` segments of 23 bits, each with the indices that
`simhash` gives it: the Golay code words within four bits. At similarity 0.8 the segments of two texts differ in 3.5 bits and share an
index with probability 0.60 (counted over 40,000 random segments; always up to two bits, 0.79 at 0.9). The 64 bits of one fingerprint
within two bits would find few such pairs, so there are 16 segments. An index has only 12 bits; as a key of `simhash` begins with
a segment that is free of errors, one of these begins with `ROWS` MinHash values, which agree with probability 0.64. Two texts at similarity s share a
key with probability 1 - (1 - s^2 g)^16, g being that of the index: 0.9996 at 0.8, more above. Bands that nobody else has go before
their indices are made.

Texts with equal sets collapse to one node, and keys with equal members to one key. The members of a key meet in one task with their sets,
once, and only star links leave it. Inside, a pair is looked at only if it shares one of the shingles that come first in both
sets, rarest first: at similarity 0.8 these are a fifth of a set and one more, and a passage that all members hold is never among
them. That rule is exact. A key whose members have more than `MOST` shingles is dealt out anew by the same rule: every shingle at
the start of a set, by a frequency that is counted over a bounded sample, is a key (any order is right, a good one makes small keys).
Members of a key that is still too large are cut into blocks, and every two blocks meet in a task. Components come last, in one run.

Cases: a null or empty text has no shingle, and all such texts are one node; a text of fewer words than a shingle is one shingle. A
text of any length is one set. Rows of one doc_id and text are one document; an empty table has no rows in the result; columns of
the input may have any names, and go on unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mldiag.llm import simhash
from mldiag.llm.common import bytes_of, map_batches, stored

WIDTH = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 2
SEED = 42
PART = 2_040
#: Words of 64 bits that hold the segments.
WORDS = -(-BANDS * simhash.GOLAY_BITS // 64)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Shingles of all members of a key that meet in a task.
MOST = 2_000_000
#: Nodes whose shingles are counted for the order, and shingles that get a count.
SAMPLE, COMMON = 20_000, 200_000
#: Members that share a shingle at the start: all pairs up to so many are looked at one by one, more in blocks.
FEW, BLOCK, COLUMNS = 64, 256, 8_192


def shingles(content: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    import xxhash

    words = content.translate(simhash.LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist())], np.uint64))


def sketch(hashes: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each band the hash of its number and MinHash values, and a segment of the set's SimHash. The first `WORDS` factors are for the SimHash."""
    import xxhash

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    counts = np.zeros(WORDS * 64, np.int64)
    for at in range(0, len(hashes), PART):
        mixed = hashes[at : at + PART, None] * factors + terms
        mixed ^= mixed >> np.uint64(29)
        np.minimum(least, mixed[:, WORDS:].min(axis=0), out=least)
        words = mixed[:, :WORDS] * FACTOR
        words ^= words >> np.uint64(32)
        bits = np.unpackbits(words.astype("<u8").view(np.uint8).ravel(), bitorder="little").reshape(-1, WORDS * 64)
        for i in range(0, len(bits), 255):  # one byte counts so many
            counts += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    ones = (2 * counts > len(hashes))[: BANDS * simhash.GOLAY_BITS].reshape(BANDS, simhash.GOLAY_BITS)
    bands = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(bands, np.uint64), ones @ (1 << np.arange(simhash.GOLAY_BITS))


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, fp, n, bands, segments): one row per input row; fp is the hash of the shingle set, n its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rng = np.random.default_rng(SEED)
        factors = rng.integers(0, 1 << 63, WORDS + BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
        terms = rng.integers(0, 1 << 63, WORDS + BANDS * ROWS, np.uint64)
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            found, sizes, sketches = [], [], []
            for content in bytes_of(batch.column(1)):
                hashes = shingles(content, width)
                found.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0)
                sizes.append(len(hashes))
                sketches.append(sketch(hashes, factors, terms) if len(hashes) else none)
            columns = [
                pa.array(np.array(found, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                pa.array([b.view(np.int64) for b, _ in sketches], pa.list_(pa.int64())), pa.array([s.astype(np.int32) for _, s in sketches], pa.list_(pa.int32())),
            ]
            names = ["doc_id", "text_hash", "fp", "n", "bands", "segments"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names)

    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return map_batches(texts, run, "doc_id bigint, text_hash bigint, fp bigint, n bigint, bands array<bigint>, segments array<int>")


def _golay_keys(table: np.ndarray, sizes: np.ndarray):
    """(key, fp, n) of (band, segment, fp, n): one row for every Golay index of the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band, segment, fp, n = (np.asarray(c) for c in batch.columns)
            rows, index = simhash.code_indices(segment, table, sizes)
            key = band.view(np.uint64)[rows] ^ (index.astype(np.uint64) * FACTOR)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key.view(np.int64), fp[rows], n[rows])], ["key", "fp", "n"])

    return run


def segment_keys(nodes: DataFrame) -> DataFrame:
    """(key, fp, n): the bands that a node (fp, n, bands, segments) shares with others, with every Golay index of their segments."""
    sketches = nodes.select(F.explode(F.arrays_zip("bands", "segments")).alias("s"), "fp", "n")
    bands = sketches.select(F.col("s.bands").alias("band"), F.col("s.segments").alias("segment"), "fp", "n")
    shared = bands.groupBy("band").count().filter("count > 1").select("band")
    both = bands.join(shared, "band").select("band", "segment", "fp", "n")
    return map_batches(both, _golay_keys(*simhash.golay_indices()), "key bigint, fp bigint, n bigint")


def prefix_length(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """How many shingles at the start of two sets in one order hold a common one, if the sets are alike."""
    return sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    low, high = sorted((len(x), len(y)))
    if low < similarity * high:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (low + high - both)


class Labels:
    """Union of members under the smallest one."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def of(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, k: int) -> None:
        i, k = self.of(i), self.of(k)
        self.parent[max(i, k)] = min(i, k)


def _compare_blocks(members: np.ndarray, sizes: np.ndarray, owner: np.ndarray, shingle: np.ndarray, similarity: float, labels: Labels) -> None:
    """Joins all members that are alike, by products of blocks of the member x shingle matrix; (owner, shingle) are its entries."""
    members = members[np.argsort(sizes[members], kind="stable")]
    place = np.full(len(sizes), -1)
    place[members] = np.arange(len(members))
    inside = place[owner] >= 0
    row, (_, column, counts) = place[owner[inside]], np.unique(shingle[inside], return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    row, column = row[shared], column[shared]
    column = (np.cumsum(counts > 1) - 1)[column]
    width = int(column.max()) + 1 if len(column) else 0
    starts = range(0, len(members), BLOCK)
    part = {}
    order = np.lexsort((column // COLUMNS, row // BLOCK))
    row, column = row[order], column[order]
    code = (row // BLOCK) * (width // COLUMNS + 1) + column // COLUMNS
    cuts = np.flatnonzero(np.diff(code)) + 1
    for r, c in zip(np.split(row, cuts), np.split(column, cuts)):
        if len(r):
            part[r[0] // BLOCK, c[0] // COLUMNS] = (r % BLOCK, c % COLUMNS)

    def dense(block: int, chunk: int) -> np.ndarray | None:
        if (block, chunk) not in part:
            return None
        out = np.zeros((BLOCK, COLUMNS), np.float32)
        out[part[block, chunk]] = 1
        return out

    for a, first in enumerate(starts):
        own = members[first : first + BLOCK]
        for b in range(a, len(starts)):
            other = members[b * BLOCK : (b + 1) * BLOCK]
            if sizes[own[-1]] < similarity * sizes[other[0]]:
                break
            both = np.zeros((BLOCK, BLOCK), np.float32)
            for chunk in range(width // COLUMNS + 1):
                x = dense(a, chunk)
                y = x if a == b else dense(b, chunk)
                if x is not None and y is not None:
                    both += x @ y.T
            both = both[: len(own), : len(other)]
            hits = both >= similarity * (sizes[own][:, None] + sizes[other][None, :] - both)
            for i in range(len(own)):
                found = np.array([labels.of(k) for k in other[hits[i]].tolist()], np.int64)
                for k in np.unique(found).tolist():
                    labels.join(int(own[i]), k)


def linked(sets: Sequence[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each set the first one that it is linked to through alike sets."""
    m = len(sets)
    labels = Labels(m)
    if m == 2:
        return np.array([0, 0 if alike(*sets, similarity) else 1])
    sizes = np.fromiter(map(len, sets), np.int64, m)
    owner = np.repeat(np.arange(m), sizes)
    _, shingle, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((shingle, counts[shingle], owner))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = order[(place < prefix_length(sizes, similarity)[owner]) & (counts[shingle[order]] > 1)]
    first = first[np.argsort(shingle[first], kind="stable")]
    lists = np.split(owner[first], np.flatnonzero(np.diff(shingle[first])) + 1) if len(first) else []
    families = Labels(m)
    large = [x for x in lists if len(x) > FEW]
    for x in large:
        for k in x[1:].tolist():
            families.join(int(x[0]), k)
    if large:
        family = np.array([families.of(i) for i in range(m)])
        for f in np.unique(family[np.unique(np.concatenate(large))]).tolist():
            _compare_blocks(np.flatnonzero(family == f), sizes, owner, shingle, similarity, labels)
    codes = [np.zeros(0, np.int64)]
    for x in lists:
        if 1 < len(x) <= FEW:
            i, k = np.triu_indices(len(x), 1)
            codes.append(x[i] * m + x[k])
    pairs = np.unique(np.concatenate(codes))
    a, b = pairs // m, pairs % m
    fit = np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b])
    if large:
        fit &= family[a] != family[b]
    for i, k in zip(a[fit].tolist(), b[fit].tolist()):
        if labels.of(i) != labels.of(k) and alike(sets[i], sets[k], similarity):
            labels.join(i, k)
    return np.array([labels.of(i) for i in range(m)])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(content, width).tobytes() for content in bytes_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["fp", "hashes"])

    return run


def _verified(similarity: float):
    """Input (key, fp, hashes) sorted by key; a key may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, [], []

        def links() -> pa.RecordBatch:
            a = np.array(nodes, np.int64)
            b = a[linked(sets, similarity)] if len(sets) > 1 else a
            return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

        for batch in batches:
            for k, node, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if k != key and nodes:
                    yield links()
                    nodes, sets = [], []
                key = k
                nodes.append(node)
                sets.append(np.frombuffer(hashes.as_py(), np.uint64))
        if nodes:
            yield links()

    return run


def distinct_keys(members: DataFrame) -> DataFrame:
    """(key, size): keys of several members, one of those with the same members; size is all shingles of the members."""
    same = [F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "fp")).alias("y")]
    keys = members.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("size"), *same).filter("m > 1")
    return keys.groupBy("m", "size", "x", "y").agg(F.min("key").alias("key")).select("key", "size")


def prefix_keys(sets: DataFrame, similarity: float) -> DataFrame:
    """(key, fp, n): every shingle at the start of a set, rarest first, is a key of the node."""
    total = max(1, sets.count())
    draw = F.pmod(F.xxhash64(F.lit(2), "fp"), F.lit(1 << 30)) < int(min(1, SAMPLE / total) * (1 << 30))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in bytes_of(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(content, np.int64))], ["h"])

    counts = map_batches(sets.filter(draw).select("hashes"), spread, "h bigint").groupBy("h").count().filter("count > 1")
    common = counts.orderBy(F.desc("count"), "h").limit(COMMON).collect()  # bounded by COMMON
    known = np.array(sorted((r.h, r["count"]) for r in common), np.int64).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, content in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
                hashes = np.frombuffer(content, np.int64)
                counts = np.zeros(len(hashes), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known[:, 0], hashes), len(known) - 1)
                    counts = np.where(known[at, 0] == hashes, known[at, 1], 0)
                take = int(prefix_length(np.array([len(hashes)]), similarity)[0])
                keys = hashes[np.lexsort((hashes, counts))[:take]]
                columns = [keys, np.full(len(keys), node, np.int64), np.full(len(keys), len(hashes), np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "fp", "n"])

    return map_batches(sets.select("fp", "hashes"), run, "key bigint, fp bigint, n bigint")


def links(nodes: DataFrame, docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, most: int = MOST) -> DataFrame:
    """(a, b): enough links between the nodes (fp, text_hash, n, bands, segments) to join all that share a key and are alike enough."""
    members = stored(segment_keys(nodes), "keys")
    members = stored(members.join(distinct_keys(members), "key").select("key", "fp", "size"), "members")
    wanted = nodes.join(members.select("fp").distinct(), "fp", "left_semi").select("fp", "text_hash")
    text = F.col("text").cast("string")
    texts = docs.select(text.alias("text"), F.xxhash64(text).alias("text_hash")).join(wanted, "text_hash").select("fp", "text")
    sets = stored(map_batches(texts.dropDuplicates(["fp"]), _sets(width), "fp bigint, hashes binary"), "shingles")
    groups = members.filter(F.col("size") <= most).select("key", "fp")
    hot = members.filter(F.col("size") > most).select("fp").distinct()
    if hot.limit(1).count():
        starts = stored(prefix_keys(sets.join(hot, "fp", "left_semi"), similarity), "starts")
        starts = stored(starts.join(distinct_keys(starts), "key").select("key", "fp", "size"), "members")
        groups = groups.unionByName(starts.filter(F.col("size") <= most).select("key", "fp"))
        parts = F.ceil(F.col("size") * 2 / F.lit(most)).cast("bigint")
        blocks = starts.filter(F.col("size") > most).select("key", "fp", parts.alias("parts"))
        blocks = blocks.withColumn("own", F.pmod(F.xxhash64(F.lit(3), "fp"), F.col("parts")))
        blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        groups = groups.unionByName(blocks.select(pair.alias("key"), "fp"))
    together = groups.join(sets, "fp").select("key", "fp", "hashes").repartition("key").sortWithinPartitions("key")
    return map_batches(together, _verified(similarity), "a bigint, b bigint").distinct()


def deduplicate(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows whose doc_id is the smallest of their component, with the columns of the input."""
    rows = stored(signatures(docs, width), "signatures")
    same = [F.first(c).alias(c) for c in ("n", "bands", "segments")]
    nodes = rows.groupBy("fp").agg(F.min("text_hash").alias("text_hash"), *same)
    found = simhash.named_components(rows.drop("n", "bands", "segments"), links(stored(nodes, "nodes"), docs, width, similarity))
    return simhash.keep_least(docs, found)
