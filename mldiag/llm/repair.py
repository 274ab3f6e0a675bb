"""Token ids in Re-Pair compressed blocks.

Texts are encoded with the tokenizers library, an end id is put behind each document, and the stream of ids in ascending doc_id order
is cut into blocks. In a block, frequent neighbouring ids are replaced by nonterminals, round by round: a round counts all
pairs, takes those that occur often enough, and replaces every occurrence that beats the ones it overlaps with, until no pair occurs
often enough. After a round only places are counted whose pair was frequent or is new. What is
left is a sequence over the block's alphabet and rules. Rules carry their expansion length and every 1,024th symbol its
place, so that any stretch of ids is decoded without the ids before it.

File format: `blocks` is a Parquet table with a row a block: part (ascending with doc_id), block, start (ids before it in the part),
n_ids, doc_ids and doc_lengths of the documents' pieces in it (a piece of a document that began in an earlier block comes first
and `continued` is set), and payload. `index` is a Parquet table (part, first_id, n_ids). A payload is little-endian: the magic
RPR2, seven unsigned 32-bit integers (ids, alphabet, rules, symbols, bits a symbol, bytes a length, crc32 of the rest), the alphabet
and marks (32 bits each), the lengths of the rules, and their left sides, their right sides and the symbols: the low two bytes
of each, then a packed plane for every bit beyond 16. Spark commits both tables, so a lost executor leaves no half
of a block.

Cases: a null text counts as empty and holds the end id alone; null identifiers come first; rows of one identifier are ordered by
content and each has its own start; a text longer than a block goes on in the next one; an empty table
gives empty files; other columns have no part in it.
"""

from __future__ import annotations

import json
import os
import string
import struct
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mldiag.llm.common import map_batches, text_or_empty
from mldiag.llm.ragged import Remembered, gather

END = 1
BLOCK_IDS = 1 << 20
#: Symbols that two bytes can name.
NARROW = 1 << 16
MARK = 1024
MAGIC = b"RPR2"
HEAD = "<4s7I"
#: Bytes of texts, and words, that are encoded together.
TEXT_AT_ONCE, WORDS_AT_ONCE = 1 << 23, 1 << 21
#: Fixed value: how a tokenizer parts runs of letters, digits and marks; marks never join a letter or digit before them.
PARTED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ordered = np.sort(codes)
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[starts], np.diff(np.append(starts, len(ordered))).astype(np.int32)


def _find(pairs: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among the pairs or -1, whether the code may be a pair) of each code, by a table of hashes; of pairs with one hash the last is found."""
    bits = max(12, min(20, int(len(pairs)).bit_length() + 3))
    factor = codes.dtype.type(0x9E3779B1 if codes.dtype == np.uint32 else 0x9E3779B97F4A7C15)
    shift = codes.dtype.type(codes.dtype.itemsize * 8 - bits)
    slots, number = (pairs * factor) >> shift, np.arange(len(pairs), dtype=np.int32)
    table = np.zeros(1 << bits, np.int32)
    table[slots] = number
    shared = np.zeros(1 << bits, bool)
    shared[slots[table[slots] != number]] = True
    slots = (codes * factor) >> shift
    at = table[slots]
    found = pairs[at] == codes
    return np.where(found, at, np.int32(-1)), found | shared[slots]


def _winners(place: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the places, in order and with weights above 0, hold a pair that beats the overlapping ones; of a run of equals
    every second one. No two of them touch."""
    n = len(place)
    left, right = np.zeros(n, weight.dtype), np.zeros(n, weight.dtype)
    touch = np.flatnonzero(place[1:] == place[:-1] + 1)
    left[touch + 1], right[touch] = weight[touch], weight[touch + 1]
    number = np.arange(n, dtype=np.int32)
    start = np.maximum.accumulate(np.where(weight != left, number, np.int32(0)))
    even = ((number - start) & 1) == 0
    return np.flatnonzero(even & ((number != start) | (left < weight)) & (right <= weight))


def _bits(size: int) -> int:
    """Bits a symbol: two bytes, and a packed plane for each bit beyond."""
    return max(16, (max(1, size) - 1).bit_length())


def _pack(values: np.ndarray, bits: int) -> bytes:
    planes = [np.packbits(((values >> b) & 1).astype(np.uint8)).tobytes() for b in range(16, bits)]
    return b"".join([values.astype("<u2").tobytes(), *planes])


def _unpack(payload: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    values = np.frombuffer(payload, "<u2", n, at)
    at += 2 * n
    if bits > 16:
        values = values.astype(np.uint32)
        for b in range(16, bits):
            plane = np.frombuffer(payload, np.uint8, -(-n // 8), at)
            values |= np.unpackbits(plane, count=n).astype(np.uint32) << np.uint32(b)
            at += len(plane)
    return values, at


def least_count(size: int) -> int:
    """The fewest uses of a rule that save bytes: a use saves a symbol, a rule costs two symbols and a length of two bytes."""
    bits = _bits(size)
    return (2 * bits + 16) // bits + 1


def compress(ids: np.ndarray, room: int = NARROW) -> bytes:
    """The payload of a block: replaced until no pair occurs often enough to save bytes.

    Beyond `room` symbols each takes a bit more. All rounds are made in any case; if they don't make up for that bit, the
    block is written as it was with `room` symbols."""
    if len(ids) and int(ids.max()) < 1 << 22:
        there = np.bincount(ids) > 0
        alphabet, symbols = np.flatnonzero(there), (np.cumsum(there, dtype=np.uint32) - np.uint32(1))[ids]
    else:
        alphabet, symbols = np.unique(ids.astype(np.uint32), return_inverse=True)
        symbols = symbols.astype(np.uint32)
    size, lefts, rights = len(alphabet), [], []
    live = np.ones(len(symbols), bool)  # places whose pair may be frequent: a pair that is not can't become so
    narrow_end = None  # symbols and rounds when the alphabet was full
    min_count = least_count(size)
    while len(symbols) > 1:
        if least_count(size) != min_count:
            min_count = least_count(size)
            live[:] = True
        narrow = size <= 1 << 16
        live[-1] = False
        here = np.flatnonzero(live)
        if narrow:
            codes = (symbols[here] << np.uint32(16)) | symbols[here + 1]
        else:
            codes = (symbols[here].astype(np.uint64) << np.uint64(32)) | symbols[here + 1]
        if not len(codes):
            break
        pairs, counts = _counted(codes)
        shift = codes.dtype.type(16 if narrow else 32)
        low = codes.dtype.type((1 << int(shift)) - 1)
        often = np.flatnonzero(counts >= min_count)
        twins = often[pairs[often] >> shift == pairs[often] & low]
        if len(twins):  # of a run of one symbol every second place counts
            twin = here[symbols[here] == symbols[here + 1]]
            starts = np.flatnonzero(np.append(True, np.diff(twin) != 1))
            halves = (np.diff(np.append(starts, len(twin))) + 1) // 2
            counts[twins] = np.bincount(symbols[twin[starts]], halves, minlength=size)[(pairs[twins] & low).astype(np.int64)]
            often = often[counts[often] >= min_count]
        if not len(often):
            break
        pairs, counts = pairs[often], counts[often]
        at, live[here] = _find(pairs, codes)
        frequent = np.flatnonzero(at >= 0)
        place, which = here[frequent], at[frequent]
        won = _winners(place, counts[which])
        used = np.bincount(which[won], minlength=len(pairs))
        good = used >= min_count
        if not good.any():  # pairs of one weight have split the places: now no two weigh the same, and the heaviest gets all of its own
            rank = np.empty(len(pairs), np.int32)
            rank[np.argsort(counts, kind="stable")] = np.arange(1, len(pairs) + 1)
            at = np.minimum(np.searchsorted(pairs, codes), len(pairs) - 1)
            frequent = np.flatnonzero(pairs[at] == codes)
            place, which = here[frequent], at[frequent]
            won = _winners(place, rank[which])
            used = np.bincount(which[won], minlength=len(pairs))
            good = used >= min_count
        if size < room < size + int(good.sum()):  # fill the alphabet with the most used first
            best = np.flatnonzero(good)
            good[best[np.argsort(-used[best], kind="stable")[room - size :]]] = False
        elif size == room and narrow_end is None:
            narrow_end = symbols, len(lefts)
        won = won[good[which[won]]]
        places, which = place[won], which[won]
        name = size + np.cumsum(good) - 1
        chosen = pairs[good].astype(np.uint64)
        lefts.append((chosen >> np.uint64(shift)).astype(np.uint32))
        rights.append((chosen & np.uint64(low)).astype(np.uint32))
        if narrow_end is not None and narrow_end[0] is symbols:
            symbols = symbols.copy()
        symbols[places] = name[which]
        live[places] = True
        live[places[places > 0] - 1] = True
        stay = np.ones(len(symbols), bool)
        stay[places + 1] = False
        symbols, live = symbols[stay], live[stay]
        size += int(good.sum())
    found = _payload(len(ids), alphabet, lefts, rights, symbols)
    if narrow_end is None:
        return found
    symbols, rounds = narrow_end
    return min(found, _payload(len(ids), alphabet, lefts[:rounds], rights[:rounds], symbols), key=len)


def _payload(n_ids: int, alphabet: np.ndarray, lefts: list, rights: list, symbols: np.ndarray) -> bytes:
    left = np.concatenate(lefts) if lefts else np.zeros(0, np.uint32)
    right = np.concatenate(rights) if rights else np.zeros(0, np.uint32)
    lengths = _rule_lengths(len(alphabet), left, right)
    every = np.append(np.ones(len(alphabet), np.int64), lengths)[symbols]
    marks = (np.cumsum(every) - every)[::MARK].astype("<u4")
    bits = _bits(len(alphabet) + len(left))
    size = "<u2" if lengths.max(initial=0) < 1 << 16 else "<u4"
    body = b"".join([alphabet.astype("<u4").tobytes(), marks.tobytes(), lengths.astype(size).tobytes(), _pack(left, bits), _pack(right, bits), _pack(symbols, bits)])
    return struct.pack(HEAD, MAGIC, n_ids, len(alphabet), len(left), len(symbols), bits, int(size[-1]), zlib.crc32(body)) + body


def _levels(terminals: int, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rules that refer to symbols before the run only."""
    highest = np.maximum(left, right).astype(np.int64)
    start = 0
    while start < len(left):
        over = np.flatnonzero(highest[start:] >= terminals + start)
        stop = start + int(over[0]) if len(over) else len(left)
        yield start, stop
        start = stop


def _rule_lengths(terminals: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    lengths = np.ones(terminals + len(left), np.int64)
    for a, b in _levels(terminals, left, right):
        lengths[terminals + a : terminals + b] = lengths[left[a:b]] + lengths[right[a:b]]
    return lengths[terminals:]


class Block:
    """A payload, opened: ids of any stretch."""

    def __init__(self, payload: bytes):
        magic, self.n_ids, n_alphabet, n_rules, n_symbols, bits, size, check = struct.unpack_from(HEAD, payload)
        if magic != MAGIC or zlib.crc32(payload[struct.calcsize(HEAD) :]) != check:
            raise ValueError("not a whole block")
        at = struct.calcsize(HEAD)

        def array(n: int, kind: str) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(payload, kind, n, at)
            at += found.nbytes
            return found

        alphabet, self.marks, lengths = array(n_alphabet, "<u4"), array(-(-n_symbols // MARK), "<u4"), array(n_rules, f"<u{size}")
        left, at = _unpack(payload, at, n_rules, bits)
        right, at = _unpack(payload, at, n_rules, bits)
        self.symbols, at = _unpack(payload, at, n_symbols, bits)
        self.lengths = np.append(np.ones(n_alphabet, np.int64), lengths)
        # all symbols expanded, one behind the other
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.zeros(int(self.lengths.sum()), np.uint32)
        self.flat[:n_alphabet] = alphabet
        for a, b in _levels(n_alphabet, left, right):
            both = np.column_stack([left[a:b], right[a:b]]).ravel()
            first = self.starts[n_alphabet + a]
            found = gather(self.flat, self.starts[both], self.lengths[both])
            self.flat[first : first + len(found)] = found

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return self.flat[:0]
        first = (int(np.searchsorted(self.marks, start, "right")) - 1) * MARK
        last = int(np.searchsorted(self.marks, stop, "left")) * MARK
        symbols = self.symbols[first:last]
        offset = start - int(self.marks[first // MARK])
        return gather(self.flat, self.starts[symbols], self.lengths[symbols])[offset : offset + stop - start]


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: 1 for ASCII letters and digits, 2 for the marks that never join one before them: all but the apostrophe, which begins 's and the like.
KINDS = bytes(1 if chr(c) in string.ascii_letters + string.digits else 2 if chr(c) in string.punctuation.replace("'", "") else 0 for c in range(256))
#: A module of this worker process that holds its encoders; functions come to a worker by value, so their own module's names don't last.
KEPT = "mldiag_kept_encoders"


def parted(content: bytes) -> tuple[bytes, np.ndarray]:
    """A blank between an ASCII letter or digit and a mark that follows it; and the places of these marks."""
    kinds = np.frombuffer(content.translate(KINDS), np.uint8)
    at = np.flatnonzero(kinds[:-1] & (kinds[1:] >> 1)) + 1
    return np.insert(np.frombuffer(content, np.uint8), at, 32).tobytes() if len(at) else content, at


class WordEncoder:
    """Ids of whole texts. No token of a tokenizer that drops white space crosses it, so words are encoded apart and remembered.
    Arrow finds the distinct words of many texts; only these are looked up one by one.

    Where the tokenizer lowers letters, ASCII letters are lowered first; where it parts runs of letters from marks, so does a cut
    between an ASCII letter or digit and a mark. Both only let more words be the same. Texts that might hold an added token in capitals are left as they are."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark keeps the cores busy
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        spec = json.loads(tokenizer_json)
        normalizer, parting = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        self.lowers = any(n.get("type") == "Lowercase" for n in [normalizer, *normalizer.get("normalizers", [])])
        patterns = [p.get("pattern", {}).get("Regex") for p in [parting, *parting.get("pretokenizers", [])] if p.get("type") == "Split"]
        self.cut = patterns == [PARTED]
        self.added = [t["content"].lower().encode() for t in spec.get("added_tokens", [])]

        ends = [t for t, i in sorted(tokenizer.get_vocab(True).items(), key=lambda x: x[1])]
        suffix = (spec.get("model") or {}).get("end_of_word_suffix")
        last = np.array([bool(suffix) and t.endswith(suffix) for t in ends])

        def encode(words: list[bytes]) -> list[list[int]]:
            """Letters alone are one word with an end mark, so they are encoded in one go and parted at the marks."""
            texts = [w.decode("utf-8", "replace") for w in words]
            found: list = [None] * len(texts)
            plain = [i for i, t in enumerate(texts) if t.isalpha()] if suffix and self.cut else []
            for at in range(0, len(plain), 1000):
                part = plain[at : at + 1000]
                ids = tokenizer.encode_batch_fast([" ".join([texts[i] for i in part])], add_special_tokens=False)[0].ids
                stops = np.flatnonzero(last[ids]) + 1 if ids else np.zeros(0, int)
                if len(stops) == len(part) and stops[-1] == len(ids):
                    for i, start, stop in zip(part, [0, *stops[:-1].tolist()], stops.tolist()):
                        found[i] = ids[start:stop]
            rest = [i for i, f in enumerate(found) if f is None]
            for i, e in zip(rest, tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
                found[i] = e.ids
            return found

        self.words = Remembered(encode, np.uint32, 700_000)

    def encode(self, content: bytes) -> np.ndarray:
        return next(self.encode_all(pa.array([content], pa.binary())))

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        before = np.cumsum(np.append(0, pc.binary_length(texts).to_numpy()))[:-1]
        cuts = np.flatnonzero(np.diff(before // TEXT_AT_ONCE)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
            if start < stop:
                yield from self._together(texts[start:stop])

    def _together(self, texts: pa.Array) -> Iterator[np.ndarray]:
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        content = texts.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes() if ends[-1] > ends[0] else b""
        ends = ends - ends[0]
        low = content.translate(LOWER)
        if not any(a in low for a in self.added):
            content = low if self.lowers else content
            if self.cut:
                content, at = parted(content)
                ends = ends + np.searchsorted(at, ends)
        elif len(texts) > 1:
            half = len(texts) // 2
            yield from self._together(texts[:half])
            yield from self._together(texts[half:])
            return
        whole = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(content)])
        split = pc.ascii_split_whitespace(whole)
        words, ids, lengths = split.flatten(), [self.words.flat[:0]], [self.words.lengths[:0]]
        for i in range(0, len(words), WORDS_AT_ONCE):
            part = words[i : i + WORDS_AT_ONCE].dictionary_encode()
            distinct = part.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
            at = self.words.places(distinct)[part.indices.to_numpy()]
            lengths.append(self.words.lengths[at])
            ids.append(gather(self.words.flat, self.words.starts[at], lengths[-1]))
        found = np.concatenate(ids)
        ends = np.append(0, np.cumsum(np.concatenate(lengths)))[split.offsets.to_numpy()]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            yield found[a:b]


def kept_encoder(tokenizer_json: str) -> WordEncoder:
    """The encoder of this worker process, which keeps it and its words from task to task."""
    kept = sys.modules.setdefault(KEPT, types.ModuleType(KEPT)).__dict__
    key = f"_{zlib.crc32(tokenizer_json.encode())}"
    if key not in kept:
        kept[key] = WordEncoder(tokenizer_json)
    return kept[key]


def _write_blocks(tokenizer_json: str, block_ids: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_encoder(tokenizer_json)
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        pieces: list[tuple] = []
        n_held = number = start = 0
        continued = False

        def row() -> pa.RecordBatch:
            ids = np.concatenate(held)
            columns = [
                pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([[d for d, _ in pieces]], pa.list_(pa.int64())), pa.array([[n for _, n in pieces]], pa.list_(pa.int64())),
                pa.array([continued], pa.bool_()), pa.array([compress(ids)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1))):
                ids = np.append(ids, np.uint32(end))
                at = 0
                while at < len(ids):
                    piece = ids[at : at + block_ids - n_held]
                    held.append(piece)
                    pieces.append((doc_id, len(piece)))
                    n_held += len(piece)
                    at += len(piece)
                    if n_held == block_ids:
                        yield row()
                        start, number, n_held, held, pieces, continued = start + n_held, number + 1, 0, [], [], at < len(ids)
        if n_held:
            yield row()

    return run


BLOCK_SCHEMA = (
    "part int, block bigint, start bigint, n_ids bigint, doc_ids array<bigint>, doc_lengths array<bigint>, continued boolean, payload binary"
)


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, end: int = END, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all documents, in ascending doc_id order, to the folder `path`."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    map_batches(dealt, _write_blocks(tokenizer_json, block_ids, end), BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    parts = docs.sparkSession.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    first = F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first_id")
    parts.select("part", first, "n_ids").write.parquet(f"{path}/index")


def _read_documents(ids_too: bool):
    """Blocks of a part in order; documents that go on in the next block are put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list = []  # part, doc_id, start, length, crc, ids
        out: list[tuple] = []
        n_out = 0

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            names = ("part", "doc_id", "start", "n_tokens", "ids_crc32", "ids")
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)][: 6 if ids_too else 5], names[: 6 if ids_too else 5])

        def close() -> None:
            if open_:
                out.append((*open_[:5], np.concatenate(open_[5]).tolist() if ids_too else None))
                open_.clear()

        for batch in batches:
            part_, _, start_, n_, doc_ids, lengths, continued, payload = batch.columns
            for i in range(batch.num_rows):
                part, at = part_[i].as_py(), start_[i].as_py()
                ids = Block(payload[i].as_py()).ids()
                place = 0
                for k, (doc_id, n) in enumerate(zip(doc_ids[i].as_py(), lengths[i].as_py())):
                    piece = ids[place : place + n]
                    if k or not continued[i].as_py():
                        close()
                        open_[:] = [part, doc_id, at + place, 0, 0, []]
                    open_[3] += n
                    open_[4] = zlib.crc32(piece.astype("<u4").tobytes(), open_[4])
                    if ids_too:
                        open_[5].append(piece)
                    place += n
                n_out += len(ids)
                if len(out) >= 10_000 or ids_too and n_out > 1 << 20:
                    yield rows()
                    out, n_out = [], 0
        close()
        yield rows()

    return run


def read_documents(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document in the files."""
    stored = spark.read.parquet(f"{path}/blocks")
    dealt = stored.repartition("part").sortWithinPartitions("part", "block").select([x.split()[0] for x in BLOCK_SCHEMA.split(", ")])
    kinds = "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if ids else "")
    found = map_batches(dealt, _read_documents(ids), kinds)
    index = spark.read.parquet(f"{path}/index").select("part", "first_id")
    columns = ["doc_id", (F.col("start") + F.col("first_id")).alias("start"), "n_tokens", "ids_crc32"] + (["ids"] if ids else [])
    return found.join(index, "part").select(*columns)


def read_range(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """(position, ids) of the blocks' stretches that cover ids start to start + n of the whole stream; reads only blocks that hold any."""
    index = spark.read.parquet(f"{path}/index").filter(F.expr(f"first_id < {start + n} and first_id + n_ids > {start}"))
    rows = spark.read.parquet(f"{path}/blocks").select("part", "start", F.col("n_ids").alias("n"), "payload").join(index.select("part", "first_id"), "part")
    rows = rows.select((F.col("first_id") + F.col("start")).alias("first"), "n", "payload")
    rows = rows.filter((F.col("first") < start + n) & (F.col("first") + F.col("n") > start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, payload in zip(batch.column(0).to_pylist(), batch.column(2)):
                a = max(0, start - first)
                found = Block(payload.as_py()).ids(a, start + n - first)
                yield pa.RecordBatch.from_arrays([pa.array([first + a]), pa.array([found.tolist()], pa.list_(pa.int64()))], ["position", "ids"])

    return map_batches(rows, run, "position bigint, ids array<bigint>")
