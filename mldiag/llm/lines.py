"""Line deduplication by a sharded minimal perfect hash.

A line's key is the line stripped of ASCII white space, A-Z in lower case; its identity is a 128-bit hash. Keys are counted over all documents
(map-side first, so a line that all of them share crosses the network once a task). Those found in enough documents are dealt
over shards by their hash, and each shard gets a minimal perfect hash over its distinct line hashes: levels of bit arrays, where a hash
that is alone at its place of a level is settled there and the rest go on to the next, and its number is the count of set bits
before its own. That number indexes compact arrays: a 64-bit fingerprint, the count, and the owner (largest identifier).

Documents do not join lines: the line hashes of the documents go to the shard they belong to, and a shard's few arrays answer a
block of them at once. A shard is `KEYS` keys, about 0.7 MB; a shard that more than `PROBES` hashes probe is answered by
several tasks with a copy of its arrays each, so that a line in a third of all documents is no hot key. Only hashes that cost a document a
line come back to it.

A hash that was never counted gets some number too; the fingerprint tells, with a chance of error of 2^-64.

Cases: a null or empty text is one empty line. A row is a document: repeated rows count each. The owner of a key is the
largest doc_id, so a row without one owns a key only if no row of the key has one. Lines of rows with an equal doc_id and text share
their fate. Texts of any length are worked on one at a time. An empty table gives no rows. Only doc_id and text
are read in `drop_lines`; `deduplicate` keeps all other columns, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mldiag.llm.common import bytes_of, free_name, map_batches, stored

LEAST_CHARACTERS = 20
LEAST_DOCUMENTS = 3
#: Keys of a shard, and hashes that one task answers from it.
KEYS = 1 << 15
PROBES = 1 << 18
#: Shards are cut by the leading bits of the hash, by 16 of them at most; beyond 2^31 keys shards grow instead.
SHARD_BITS = 16
LEVELS = 40
#: Bytes of cleaned text that leave together.
SLICE = 16 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ODD = np.uint64(0x9E3779B97F4A7C15)


def line_keys(lines: list[bytes], least: int = LEAST_CHARACTERS) -> list[bytes | None]:
    """The key of each line, None where it has fewer than `least` code points."""
    keys: list[bytes | None] = []
    for line in lines:
        key = line.strip()  # the six ASCII white space bytes
        size = len(key)
        if size < least or (size < 4 * least and len(key.decode()) < least):
            keys.append(None)
        else:
            keys.append(key.translate(LOWER))
    return keys


def _identity() -> list[Column]:
    text = F.col("text").cast("string")
    return [F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")]


def line_hashes(docs: DataFrame, least: int = LEAST_CHARACTERS) -> DataFrame:
    """(doc_id, text_hash, h, f): the halves of the hash of every distinct key of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            found, rows = [], []
            for i, content in enumerate(bytes_of(batch.column(1))):
                distinct = {digest(key) for key in line_keys(content.split(b"\n"), least) if key is not None}
                found.extend(distinct)
                rows.extend([i] * len(distinct))
                if len(found) > 50_000:
                    yield rows_of(batch, rows, found)
                    found, rows = [], []
            yield rows_of(batch, rows, found)

    def rows_of(batch: pa.RecordBatch, rows: list, found: list) -> pa.RecordBatch:
        halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
        at = pa.array(rows, pa.int64())
        columns = [batch.column(0).take(at), batch.column(2).take(at), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "h", "f"])

    return map_batches(docs.select(*_identity()), run, "doc_id bigint, text_hash bigint, h bigint, f bigint")


def places(h: np.ndarray, f: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where each hash stands in a level's bit array."""
    mixed = (h ^ ((f + np.uint64(level)) * ODD)) * ODD
    mixed ^= mixed >> np.uint64(32)
    return ((mixed * ODD) >> np.uint64(16)) % np.uint64(size)


class PerfectHash:
    """Minimal perfect hash: `sizes` of the levels, their bits one after the other, set bits before each word of 64."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.append(0, np.cumsum(sizes))
        self.before = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))

    @classmethod
    def build(cls, h: np.ndarray, f: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        for level in range(LEVELS):
            if len(h) == 0:
                break
            size = -(-2 * len(h) // 64) * 64
            at = places(h, f, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = ~alone[at]
            h, f = h[left], f[left]
        if len(h):
            raise ValueError("line hashes are not distinct")
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), np.packbits(flat, bitorder="little").view(np.uint64))

    def numbers(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """The number of each hash, 0 to the count of keys less one; -1 or any number for a hash that is no key."""
        out = np.full(len(h), -1, np.int64)
        open_ = np.arange(len(h))
        for level, size in enumerate(self.sizes.tolist()):
            at = self.starts[level] + places(h[open_], f[open_], level, size).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            low = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.before[at >> 6] + np.bitwise_count(low))[hit]
            open_ = open_[~hit]
        return out


INDEX = "shard int, sizes binary, words binary, fingerprints binary, counts binary, owners binary, owned binary"


def _build(table: pa.Table) -> pa.Table:
    h, f = (table.column(c).to_numpy().view(np.uint64) for c in ("h", "f"))
    made = PerfectHash.build(h, f)
    order = np.empty(len(h), np.int64)
    order[made.numbers(h, f)] = np.arange(len(h))
    owner = table.column("owner").combine_chunks()
    arrays = {
        "shard": pa.array(table.column("shard").to_numpy()[:1], pa.int32()),
        "sizes": made.sizes,
        "words": made.words,
        "fingerprints": f[order],
        "counts": table.column("n").to_numpy()[order],
        "owners": owner.fill_null(0).to_numpy()[order],
        "owned": np.asarray(owner.is_valid())[order],
    }
    return pa.table({k: v if k == "shard" else pa.array([v.tobytes()], pa.binary()) for k, v in arrays.items()})


def build_index(counts: DataFrame, bits: int) -> DataFrame:
    """One row a shard: the perfect hash over its keys, and fingerprint, count and owner of each key."""
    shard = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    return counts.select(shard.alias("shard"), "h", "f", "n", "owner").groupBy("shard").applyInArrow(_build, INDEX)


def _answer(key: tuple, index: pa.Table, probes: pa.Table) -> pa.Table:
    """The probes whose document loses the line."""
    if index.num_rows == 0 or probes.num_rows == 0:
        return probes.select(["doc_id", "text_hash", "h", "f"]).slice(0, 0)

    def array(name: str, kind) -> np.ndarray:
        return np.frombuffer(index.column(name)[0].as_py(), kind)

    h, f = (probes.column(c).to_numpy().view(np.uint64) for c in ("h", "f"))
    number = PerfectHash(array("sizes", np.int64), array("words", np.uint64)).numbers(h, f)
    hit = np.flatnonzero(number >= 0)
    hit = hit[array("fingerprints", np.uint64)[number[hit]] == f[hit]]
    ids = probes.column("doc_id").combine_chunks()
    known, ids = np.asarray(ids.is_valid()), ids.fill_null(0).to_numpy()
    owner, owned = array("owners", np.int64)[number[hit]], array("owned", bool)[number[hit]]
    keeps = (known[hit] == owned) & (ids[hit] == owner)
    return probes.select(["doc_id", "text_hash", "h", "f"]).take(pa.array(hit[~keeps]))


def lost_lines(lines: DataFrame, documents: int = LEAST_DOCUMENTS, keys: int = KEYS, probes: int = PROBES) -> DataFrame:
    """(doc_id, text_hash, h, f): which keys leave which document, for `lines` as `line_hashes` gives them."""
    spark = lines.sparkSession
    counts = lines.groupBy("h", "f").agg(F.count("*").alias("n"), F.max("doc_id").alias("owner"))
    counts = stored(counts.filter(F.col("n") >= documents), "frequent")
    bits = min(SHARD_BITS, max(0, (-(-counts.count() // keys) - 1).bit_length()))
    index = stored(build_index(counts, bits), "index")
    shard = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    probed = lines.withColumn("shard", shard)
    # at most 2^SHARD_BITS rows: how many tasks answer each shard
    several = probed.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > probes).collect()
    copies = {r.shard: -(-r.n // probes) for r in several}
    table = spark.createDataFrame(list(copies.items()), "shard int, copies bigint")
    salt = F.pmod(F.xxhash64("doc_id", "text_hash", "h"), F.coalesce("copies", F.lit(1))).cast("int")
    probed = probed.join(F.broadcast(table), "shard", "left").withColumn("salt", salt).drop("copies")
    every = F.explode(F.sequence(F.lit(0), (F.coalesce("copies", F.lit(1)) - 1).cast("int")))
    spread = index.join(F.broadcast(table), "shard", "left").withColumn("salt", every).drop("copies", "counts")
    together = spread.groupBy("shard", "salt").cogroup(probed.groupBy("shard", "salt"))
    return together.applyInArrow(_answer, "doc_id bigint, text_hash bigint, h bigint, f bigint")


def _cleaned(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches (text, lost, ...) with (lines, dropped lines, text that stays) of each row."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    for batch in batches:
        out, start, size = [], 0, 0
        for i, (content, lost) in enumerate(zip(bytes_of(batch.column(0)), batch.column(1))):
            n, dropped, gone = content.count(b"\n") + 1, 0, lost.as_py()
            if gone:
                gone, lines = set(gone), content.split(b"\n")
                kept = [x for x, key in zip(lines, line_keys(lines, least)) if key is None or digest(key) not in gone]
                dropped, content = n - len(kept), b"\n".join(kept)
            out.append((n, dropped, content))
            size += len(content)
            if size > SLICE:
                yield batch.slice(start, i + 1 - start), out
                out, start, size = [], i + 1, 0
        yield batch.slice(start), out


def _lost_sets(docs: DataFrame, documents: int, least: int) -> DataFrame:
    """(doc_id, text_hash, lost): the 16-byte hashes of the keys that leave a text; rows for texts that lose some."""
    lines = stored(line_hashes(docs, least), "lines")
    lost = lost_lines(lines, documents)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.column_stack([np.asarray(batch.column(i)) for i in (2, 3)]).astype(np.int64)
            hashes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(both), [None, pa.py_buffer(both.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hashes.cast(pa.binary())], ["doc_id", "text_hash", "hash"])

    hashes = map_batches(lost, packed, "doc_id bigint, text_hash bigint, hash binary")
    return hashes.groupBy("doc_id", "text_hash").agg(F.collect_set("hash").alias("lost"))  # no more than a text's lines


def drop_lines(docs: DataFrame, documents: int = LEAST_DOCUMENTS, least: int = LEAST_CHARACTERS) -> DataFrame:
    """One row per input row: doc_id, n_lines (before), n_dropped, kept_text."""
    lost = _lost_sets(docs, documents, least).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "lost")
    rows = docs.select(*_identity())
    same = rows.doc_id.eqNullSafe(lost.d) & rows.text_hash.eqNullSafe(lost.t)
    joined = rows.join(lost, same, "left").select("text", "lost", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out in _cleaned(batches, least):
            columns = [batch.column(2), *(pa.array([x[i] for x in out], kind) for i, kind in ((0, pa.int64()), (1, pa.int64())))]
            texts = pa.array([x[2] for x in out], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, texts], ["doc_id", "n_lines", "n_dropped", "kept_text"])

    return map_batches(joined, run, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_text string")


def deduplicate(docs: DataFrame, documents: int = LEAST_DOCUMENTS, least: int = LEAST_CHARACTERS) -> DataFrame:
    """The input rows, `text` without the lines that leave."""
    d, t, lost = (free_name(docs, c) for c in ("d", "t", "lost"))
    sets = _lost_sets(docs, documents, least).select(F.col("doc_id").alias(d), F.col("text_hash").alias(t), F.col("lost").alias(lost))
    text = F.col("text").cast("string")
    joined = docs.join(sets, docs["doc_id"].cast("bigint").eqNullSafe(sets[d]) & F.xxhash64(text).eqNullSafe(sets[t]), "left")
    columns = [c for c in docs.columns if c != "text"]
    ordered = joined.select(text.alias("text"), lost, *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out in _cleaned(batches, least):
            cut = [x[2] if valid or x[1] else None for x, valid in zip(out, np.asarray(batch.column(0).is_valid()))]
            arrays = [pa.array(cut, pa.binary()).cast(pa.string()), *(batch.column(i) for i in range(2, batch.num_columns))]
            yield pa.RecordBatch.from_arrays(arrays, ["text", *columns])

    schema = T.StructType([T.StructField("text", T.StringType()), *(docs.schema[c] for c in columns)])
    return ordered.mapInArrow(run, schema).select(docs.columns)
