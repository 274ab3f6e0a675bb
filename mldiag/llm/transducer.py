"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model file is compiled into three machines: the normaliser (white space to U+2581, one before the text), the pieces (a
letter trie whose final states put out a piece) and byte fallback (a letter that no piece covers puts out its bytes). Each input is
composed with them, and its ids are the shortest path in the tropical semiring.

Models of type BPE merge the best-scored neighbours first, which no sum of piece scores reproduces. But a
sequence of pieces is what merging gives exactly if each two neighbours are what merging gives for the two alone. So the state after a
piece is that piece, an arc to a next piece that merging would not leave beside it has weight infinity, every other one weight one, and
each prefix of the input has one path of finite weight. Whether two pieces stay apart is looked up once a pair.

Words are composed apart, since no piece holds white space behind a letter (checked when compiling); paths of short words are
remembered. Cases: a null text counts as empty and has no ids; a text that holds U+2581 itself decodes to a space there.
An empty table gives no rows; a text of any length is cut at white space and never held twice; repeated rows are encoded one by one; columns of
the input stay, and new ones that would clash get a name with an underscore.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mldiag.llm.common import free_name, map_batches, texts_of
from mldiag.llm.ragged import Remembered, blocks

SPACE = "▁"
REMEMBERED_LENGTH = 48
WORDS_AT_ONCE = 200_000
#: Field numbers and types of the public SentencePiece model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = 1, 2, 4, 5, 6
BPE = 2


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, data[at : at + size]
            at += size


class Transducer:
    """The compiled model; small enough to travel with each task."""

    def __init__(self, model: bytes):
        trainer, normalizer, pieces = {}, {}, []
        for number, value in proto_fields(model):
            if number == PIECES:
                pieces.append(dict(proto_fields(value)))
            elif number == TRAINER:
                trainer = dict(proto_fields(value))
            elif number == NORMALIZER:
                normalizer = dict(proto_fields(value))
        if trainer.get(3, 1) != BPE or normalizer.get(2):
            raise ValueError("only BPE models with the identity normaliser are compiled")
        self.prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))
        self.texts = [p[1].decode("utf-8") for p in pieces]
        kinds = [p.get(3, NORMAL) for p in pieces]
        scores = [float(np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0]) for p in pieces]
        self.unknown = kinds.index(UNKNOWN)
        self.size = len(pieces)
        found = {t: int(t[3:5], 16) for t, k in zip(self.texts, kinds) if k == BYTE}
        by_value = {found[t]: i for i, t in enumerate(self.texts) if kinds[i] == BYTE}
        self.byte_ids = [by_value[b] for b in range(256)] if len(by_value) == 256 else None
        self.id_of = {t: i for i, (t, k) in enumerate(zip(self.texts, kinds)) if k in (NORMAL, USER_DEFINED, UNUSED)}
        self.score = {t: scores[i] for t, i in self.id_of.items()}
        self.out = [bytes([found[t]]) if k == BYTE else t.encode() if k in (NORMAL, USER_DEFINED, UNUSED) else b"" for t, k in zip(self.texts, kinds)]
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.cut = not any(SPACE in t.lstrip(SPACE) for t in self.id_of)
        # how merging makes each piece: the symbols at its left and right edge on the way
        self.left_edge: dict[int, list[str]] = {}
        self.right_edge: dict[int, list[str]] = {}
        trie: dict = {}
        for text, i in self.id_of.items():
            symbols, left, right = self.merged(text, None)
            if len(symbols) != 1:
                continue  # merging never makes this piece
            self.left_edge[i], self.right_edge[i] = left, right
            node = trie
            for c in text:
                node = node.setdefault(c, {})
            node[""] = i
        self.trie = trie
        self.apart: dict[int, bool] = {}

    def merged(self, text: str, boundary: int | None) -> tuple[list[str], list[str], list[str]]:
        """Merge the best-scored neighbours, leftmost first; stops when a merge would cross `boundary`. Also the edges' symbols."""
        symbols, left, right = list(text), [text[:1]], [text[-1:]]
        while len(symbols) > 1:
            best = None
            for i in range(len(symbols) - 1):
                score = self.score.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best[0]):
                    best = (score, i)
            if best is None:
                break
            i = best[1]
            if boundary is not None:
                start = sum(map(len, symbols[:i]))
                if start < boundary < start + len(symbols[i]) + len(symbols[i + 1]) and start + len(symbols[i]) == boundary:
                    return [], left, right
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            if i == 0:
                left.append(symbols[0])
            if i == len(symbols) - 1:
                right.append(symbols[-1])
        return symbols, left, right

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether merging leaves pieces a and b beside each other."""
        key = a * self.size + b
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            score = self.score
            known = not any(x + y in score for x in self.right_edge[a] for y in self.left_edge[b])
            if not known:
                one = self.texts[a]
                known = self.merged(one + self.texts[b], len(one))[0] == [one, self.texts[b]]
            self.apart[key] = known
        return known

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return ((SPACE if self.prefix else "") + text.replace(" ", SPACE)) if text else ""

    def path(self, word: str) -> list[int]:
        """Ids of the shortest path through the composition of a word with the machines.

        No two paths of finite weight end at one place, so the first one found is the shortest and weights need not be compared."""
        n = len(word)
        state: list[int | None] = [None] * (n + 1)  # the piece before a place; -1 at the start and behind a letter put out as bytes
        back = [0] * (n + 1)
        state[0] = -1
        apart, size, trie = self.apart, self.size, self.trie
        for at in range(n):
            last = state[at]
            if last is None:
                continue
            node = trie.get(word[at])
            if node is None:
                if state[at + 1] is None:
                    state[at + 1], back[at + 1] = -1, at
                continue
            end = at + 1
            pair = last * size
            while True:
                if "" in node and state[end] is None:
                    piece = node[""]
                    if last < 0:
                        state[end], back[end] = piece, at
                    else:
                        known = apart.get(pair + piece)
                        if self.stay_apart(last, piece) if known is None else known:
                            state[end], back[end] = piece, at
                if end == n:
                    break
                node = node.get(word[end])
                if node is None:
                    break
                end += 1
        ids: list[int] = []
        at = n
        while at:
            if state[at] >= 0:
                ids.append(state[at])
            elif self.byte_ids is None:
                ids.append(self.unknown)
            else:
                ids.extend(self.byte_ids[b] for b in reversed(word[back[at] : at].encode("utf-8", "replace")))
            at = back[at]
        return ids[::-1]


class Encoder:
    """Ids of whole texts, with the paths of short words remembered."""

    def __init__(self, machine: Transducer):
        self.machine = machine
        self.short = Remembered(lambda words: [machine.path(w) for w in words], np.uint16 if machine.size <= 1 << 16 else np.int32, 600_000)
        # a line feed that no piece holds stands alone
        line = "\n" if not any("\n" in t for t in machine.id_of) else ""
        self.words = re.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + ("|\n" if line else "")) if machine.cut else None

    def encode(self, text: str) -> np.ndarray:
        text = self.machine.normalise(text)
        if not text:
            return np.zeros(0, np.int32)
        if self.words is None:
            return np.array(self.machine.path(text), np.int32)
        found: list[np.ndarray] = []
        for block in blocks((m.group() for m in self.words.finditer(text)), WORDS_AT_ONCE) if len(text) > 1 << 20 else [self.words.findall(text)]:
            if max(map(len, block)) <= REMEMBERED_LENGTH:
                found.append(self.short.ids(block))
                continue
            start = 0
            for i in [i for i, w in enumerate(block) if len(w) > REMEMBERED_LENGTH]:
                found += [self.short.ids(block[start:i]), np.array(self.machine.path(block[i]), np.int32)]
                start = i + 1
            found.append(self.short.ids(block[start:]))
        return np.concatenate(found).astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        out = self.machine.out
        text = b"".join([out[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.machine.prefix and text.startswith(" ") else text


def read_model(path: str) -> Transducer:
    with open(path, "rb") as file:  # the driver reads it; tasks get the compiled machine
        return Transducer(file.read())


def encode(docs: DataFrame, machine: Transducer, column: str = "ids") -> DataFrame:
    """All columns but the text, n_pieces, and the ids of the whole text as array<int>; under free names where the input has such columns."""
    names = [c for c in docs.columns if c != "text"]
    count, column = free_name(docs, "n_pieces"), free_name(docs, column)
    rows = docs.select(*names, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(machine)
        for batch in batches:
            ids, ends = [], [0]
            first = 0

            def part(stop: int):
                values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
                counts = pa.array(np.diff(ends), pa.int64())
                others = [c.slice(first, stop - first) for c in batch.columns[:-1]]
                return pa.RecordBatch.from_arrays([*others, counts, lists], [*names, count, column])

            for i, text in enumerate(texts_of(batch.column(batch.num_columns - 1))):
                ids.append(encoder.encode(text))
                ends.append(ends[-1] + len(ids[-1]))
                if ends[-1] > 1 << 21:
                    yield part(i + 1)
                    ids, ends, first = [], [0], i + 1
            yield part(batch.num_rows)

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_batches(rows, run, f"{kinds}{', ' if kinds else ''}`{count}` bigint, `{column}` array<int>")


def decode(encoded: DataFrame, machine: Transducer, column: str = "ids") -> DataFrame:
    """The table with its ids replaced by the text they decode to."""
    names = [c for c in encoded.columns if c != column]
    rows = encoded.select(*names, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(machine)
        for batch in batches:
            texts = [encoder.decode(np.asarray(v.values)) if v.values is not None else None for v in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*names, "text"])

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_batches(rows, run, f"{kinds}{', ' if kinds else ''}text string")


def digest(docs: DataFrame, machine: Transducer) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and round_trip: whether the
    ids decode to the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(machine)
        names = ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"]
        kinds = [pa.int64()] * 3 + [pa.bool_()]
        for batch in batches:
            out = []
            for text in texts_of(batch.column(1)):
                ids = encoder.encode(text)
                same = encoder.decode(ids) == text.replace(SPACE, " ")
                out.append((len(ids), int(machine.is_byte[ids].sum()), zlib.crc32(ids.astype("<u4").tobytes()), same))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id bigint, n_pieces bigint, n_byte_pieces bigint, ids_crc32 bigint, round_trip boolean")
