"""Exact deduplication by Patricia-trie owners.

Texts are dealt out by byte length and content hash. Full byte strings enter compressed radix tries whose terminal nodes hold the
owner of the text (largest or smallest identifier) and the number of rows. A first round of tries runs before the shuffle, so that
a text copied a billion times crosses the network once a task; a second round, on rows sorted by (length, hash), merges those.

A trie over its memory budget spills subtrees: before the shuffle any subtree may leave early, since the second round
meets it again; after it only subtrees of finished (length, hash) keys leave, and those are final.

Cases: a null text counts as empty. A null identifier never owns a text that some identifier owns. Rows that repeat both identifier
and text are one document: all of them carry the same verdict, and `deduplicate` keeps one of them.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mldiag.llm.common import bytes_of, free_name, map_batches, stored, text_or_empty

TRIE_BYTES = 24 << 20
LEAST = -(1 << 63)


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common start of two byte strings, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """Compressed radix trie of byte strings. A node is [label, children by first byte, terminal or None]."""

    def __init__(self, largest: bool):
        self.root: list = [b"", {}, None]
        self.best = max if largest else min
        self.bytes = 0

    def insert(self, key: bytes, terminal: tuple) -> None:
        """terminal: (owner or None, rows, rows of the owner)."""
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, terminal]
                self.bytes += len(key) - at + 200
                return
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            cut = shared_prefix(label, key[at : at + len(label)])
            middle = [label[:cut], {label[cut]: child}, None]
            child[0] = label[cut:]
            node[1][key[at]] = middle
            self.bytes += 200
            node, at = middle, at + cut
        node[2] = terminal if node[2] is None else self.merged(node[2], terminal)

    def merged(self, a: tuple, b: tuple) -> tuple:
        known = [x[0] for x in (a, b) if x[0] is not None]
        owner = self.best(known) if known else None
        return owner, a[1] + b[1], sum(x[2] for x in (a, b) if x[0] == owner)

    def take(self, keep: bytes | None = None) -> Iterator[tuple[bytes, tuple]]:
        """Spill: hand out and remove all subtrees of the root but the one that `keep` lies under."""
        terminals: list[tuple[bytes, list]] = []
        if keep is None and self.root[2] is not None:
            yield b"", self.root[2]
            self.root[2] = None
        # the path of `keep` stays; whatever hangs off it goes
        node, at, path = self.root, 0, b""
        while keep is None or at < len(keep):
            for first in [k for k in node[1] if keep is None or k != keep[at]]:
                terminals.append((path, node[1].pop(first)))
            child = None if keep is None else node[1].get(keep[at])
            if child is None:
                break
            if not keep.startswith(child[0], at):
                if not child[0].startswith(keep[at:]):
                    terminals.append((path, node[1].pop(keep[at])))
                break
            path, at, node = path + child[0], at + len(child[0]), child
        while terminals:
            path, node = terminals.pop()
            path += node[0]
            self.bytes -= len(node[0]) + 200
            if node[2] is not None:
                yield path, node[2]
            terminals.extend((path, child) for child in node[1].values())


def _local_owners(largest: bool, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(largest)

        def rows():
            taken = list(trie.take())
            owners = [t[0] for _, t in taken]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in taken], pa.binary()),
                    pa.array(owners, pa.int64()),
                    pa.array([t[1] for _, t in taken], pa.int64()),
                    pa.array([t[2] for _, t in taken], pa.int64()),
                ],
                ["content", "owner", "n", "owner_rows"],
            )

        for batch in batches:
            for owner, content in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
                trie.insert(content, (owner, 1, 1))
                if trie.bytes > limit:
                    yield rows()
        yield rows()

    return run


def _final_owners(largest: bool, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(largest)

        def rows(keep: bytes | None):
            found = [(hashlib.sha256(k[12:]).hexdigest(), *t) for k, t in trie.take(keep) if t[1] > 1]
            columns = list(zip(*found)) or [(), (), (), ()]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["sha", "owner", "n", "owner_rows"])

        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in (1, 2, 3, 4, 5))
            for content, length, code, *terminal in zip(bytes_of(batch.column(0)), *columns):
                head = struct.pack(">Iq", length, code)
                trie.insert(head + content, tuple(terminal))
                if trie.bytes > limit:
                    yield rows(head)
        yield rows(None)

    return run


def owners(docs: DataFrame, largest: bool = True, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(sha, owner, n, owner_rows) of every text that more than one row holds; sha is the lower-case hex SHA-256."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    local = map_batches(texts, _local_owners(largest, trie_bytes), "content binary, owner bigint, n bigint, owner_rows bigint")
    keyed = local.select(
        "content", F.octet_length("content").alias("length"), F.xxhash64("content").alias("hash"), "owner", "n", "owner_rows"
    )
    dealt = keyed.repartition("length", "hash").sortWithinPartitions("length", "hash")
    return map_batches(dealt, _final_owners(largest, trie_bytes), "sha string, owner bigint, n bigint, owner_rows bigint")


def exact_groups(docs: DataFrame, largest: bool = True, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2(text_or_empty(), 256).alias("text_sha256"))
    found = owners(docs, largest, trie_bytes)
    joined = rows.join(found, rows.text_sha256 == found.sha, "left")
    alone = F.col("n").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("owner"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, largest: bool = True, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The rows that stay, with the columns of the input; exactly one row of each text."""
    sha = free_name(docs, "sha")
    found = stored(owners(docs, largest, trie_bytes), "owners")
    repeats = found.filter("owner_rows > 1").limit(1).count() > 0
    names = [free_name(docs, c) for c in ("owner", "n", "owner_rows")]
    owner, n, owner_rows = names
    found = found.select(F.col("sha").alias(sha), *(F.col(c).alias(x) for c, x in zip(("owner", "n", "owner_rows"), names)))
    joined = docs.withColumn(sha, F.sha2(text_or_empty(), 256)).join(found, sha, "left")
    stay = joined.filter(F.col(n).isNull() | F.col("doc_id").cast("bigint").eqNullSafe(F.col(owner)))
    if not repeats:
        return stay.select(docs.columns)
    once = F.coalesce(F.col(owner_rows), F.lit(1)) == 1
    return stay.filter(once).select(docs.columns).unionByName(stay.filter(~once).dropDuplicates([sha]).select(docs.columns))
