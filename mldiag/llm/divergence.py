"""Quality rules: distance of a document's character-class and common-word histograms from language references.

Every language with `EVIDENCE` counted words, however few of the rows, gets two reference histograms, counted over all texts of the corpus: byte
classes, and its most common words with one more bin for all other words. A document is measured against the language whose
word histogram is nearest (so a missing or wrong label does no harm), by Jensen-Shannon distance with base-2 logarithms. Distances
of short texts are large by chance, hence the minimum length and a word threshold that falls with the square root of the length.

Cases: a null or empty text has no words and fails the base rule. Without any language reference (no labels) the distances
are null and only the base rule decides; it also decides alone on a document whose own language has no reference. Rows that repeat are measured one by one.
An empty table gives no rows. A very long text is counted whole, one text at a time. Only doc_id, text, lang and the named columns are
read; `keep_good` keeps all columns of the input, whatever they are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mldiag.llm.common import bytes_of, map_batches, stored
from mldiag.llm.ragged import Numbers

COMMON_WORDS = 40
EVIDENCE = 5_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
CHAR_DISTANCE = 0.3
WORD_DISTANCE = 0.2
WORD_DISTANCE_SHORT = 1.5
FLUSH = 200_000
CODES = 1 << 21
SYMBOLS = b"#*$%&|<>"
CLASSES = 7


def _byte_classes() -> np.ndarray:
    """lower, upper, digit, white space, sentence marks, letters beyond ASCII, other; continuation bytes count for nothing."""
    table = np.full(256, 6, np.uint8)
    for c in range(256):
        if 97 <= c <= 122:
            table[c] = 0
        elif 65 <= c <= 90:
            table[c] = 1
        elif 48 <= c <= 57:
            table[c] = 2
        elif c in b" \t\n\r\x0b\x0c":
            table[c] = 3
        elif c in b".,;:'\"!?()-":
            table[c] = 4
        elif c >= 0xC0:
            table[c] = 5
        elif c >= 0x80:
            table[c] = 7
    return table


def class_counts(content: bytes, table: np.ndarray) -> np.ndarray:
    counts = np.zeros(8, np.int64)
    for at in range(0, len(content), 1 << 20):
        counts += np.bincount(table[np.frombuffer(content, np.uint8, min(1 << 20, len(content) - at), at)], minlength=8)
    return counts[:CLASSES]


def plain_word(word: bytes) -> bytes:
    return word.rstrip(b".,;:?").lower()


def _corpus_counts(flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _byte_classes()
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        rows: Counter = Counter()

        def counted():
            out = []
            for lang, counter in words.items():
                plain: Counter = Counter()
                for w, n in counter.items():
                    plain[plain_word(w)] += n
                out += [("word", lang, w, n) for w, n in plain.items()]
                out += [("class", lang, b"%d" % i, int(n)) for i, n in enumerate(classes[lang])]
                out.append(("rows", lang, b"", rows[lang]))
            words.clear(), classes.clear(), rows.clear()
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "lang", "item", "n"])

        for batch in batches:
            for lang, content in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
                if lang not in words:
                    words[lang], classes[lang] = Counter(), np.zeros(CLASSES, np.int64)
                words[lang].update(content.split())
                classes[lang] += class_counts(content, table)
                rows[lang] += 1
                if sum(map(len, words.values())) > flush:
                    yield counted()
        yield counted()

    return run


@dataclass
class Reference:
    lang: str
    words: list[bytes]
    word_shares: np.ndarray  # the last one is all other words
    class_shares: np.ndarray


def references(docs: DataFrame, common_words: int = COMMON_WORDS, evidence: int = EVIDENCE) -> list[Reference]:
    """One reference for each language with enough counted words; common_words words of each come to the driver."""
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    partial = map_batches(texts.filter("lang is not null"), _corpus_counts(FLUSH), "kind string, lang string, item binary, n bigint")
    counts = stored(partial.groupBy("kind", "lang", "item").agg(F.sum("n").alias("n")), "word-counts")
    # the most common of each slice of words, then of those: no language's words meet in one task
    slice_ = F.when(F.col("kind") == "word", F.pmod(F.xxhash64("item"), F.lit(256))).otherwise(0)
    letters = F.decode("item", "UTF-8").rlike("[A-Za-z\\x{80}-\\x{10FFFF}]")
    key = ("kind", "lang", "slice")
    total = counts.groupBy("kind", "lang").agg(F.sum("n").alias("total"))
    ranked = counts.filter((F.col("kind") != "word") | letters).withColumn("slice", slice_)
    first = Window.partitionBy(*key).orderBy(F.desc("n"), "item")
    best = ranked.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= max(common_words, CLASSES))
    second = Window.partitionBy("kind", "lang").orderBy(F.desc("n"), "item")
    best = best.withColumn("r", F.row_number().over(second)).filter((F.col("kind") != "word") | (F.col("r") <= common_words))
    large = total.filter((F.col("kind") == "word") & (F.col("total") >= evidence)).select("lang")
    found = best.join(total.select("kind", "lang", "total"), ["kind", "lang"]).join(large, "lang", "left_semi").collect()
    out = []
    for lang in sorted({r.lang for r in found}):
        words = sorted((r for r in found if r.lang == lang and r.kind == "word"), key=lambda r: r.r)
        classes = np.zeros(CLASSES)
        for r in found:
            if r.lang == lang and r.kind == "class":
                classes[int(bytes(r.item))] = r.n
        if words and classes.sum():
            shares = np.array([r.n / r.total for r in words])
            out.append(Reference(lang, [bytes(r.item) for r in words], np.append(shares, 1 - shares.sum()), classes / classes.sum()))
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence, base 2: 0 to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum()
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum()
    return float(np.sqrt(max(0.0, (a + b) / 2)))


def repeated_words(ids: np.ndarray) -> int:
    """Words within windows of three that occur twice or more."""
    if len(ids) < 4:
        return 0
    if ids.max() >= CODES:
        return _repeated_wide(ids)
    windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    ordered = np.sort(windows)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    hit = np.isin(windows, again)
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def duplicate_lines(content: bytes) -> int:
    lines = [x for x in content.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


@dataclass
class Limits:
    min_words: int = MIN_WORDS
    repeat_percent: int = MAX_REPEAT_PERCENT
    char_distance: float = CHAR_DISTANCE
    word_distance: float = WORD_DISTANCE
    word_distance_short: float = WORD_DISTANCE_SHORT


MEASURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "kept boolean, nearest_lang string, word_distance double, char_distance double"
)


def _measure(refs: list[Reference], limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _byte_classes()
        places = [{w: i for i, w in enumerate(r.words)} for r in refs]
        known_langs = {r.lang for r in refs}
        codes = Numbers()
        bins = [np.zeros(1 << 12, np.int64) for _ in refs]

        def coded(words: list[bytes]) -> np.ndarray:
            """Number of each word; a new word gets the next number and its bin in each reference."""
            nonlocal codes
            if len(codes) > CODES // 4:
                codes = Numbers()
            known = len(codes)
            ids = codes.of(words)
            if len(codes) > known:
                fresh = [plain_word(w) for w in codes.order[known:]]
                for i, (r, place) in enumerate(zip(refs, places)):
                    while len(bins[i]) < len(codes):
                        bins[i] = np.append(bins[i], np.zeros(len(bins[i]), np.int64))
                    bins[i][known : len(codes)] = [place.get(w, len(r.words)) for w in fresh]
            return ids

        def measure(content: bytes, own: bool) -> tuple:
            """`own`: a reference of the document's own language exists, or its language is not known."""
            words = content.split()
            n = len(words)
            spaces = sum(content.count(c) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
            chars = len(content.decode("utf-8", "replace")) - spaces
            symbols = len(content) - len(content.translate(None, SYMBOLS))
            if n < CODES // 2:
                ids = coded(words)
                repeated = repeated_words(ids)
            else:  # a text of a million words is numbered by itself
                ids, repeated = None, repeated_words(Numbers().of(words))
            failed = n < limits.min_words or 100 * repeated > limits.repeat_percent * n
            base = (n, chars, symbols, duplicate_lines(content), repeated, failed)
            if n == 0 or not refs:
                return (*base, not failed, None, None, None)
            if ids is None:
                counter = Counter(map(plain_word, words))
                histograms = [np.array([counter[w] for w in r.words], float) for r in refs]
                histograms = [np.append(h, n - h.sum()) for h in histograms]
            else:
                histograms = [np.bincount(b[ids], minlength=len(r.words) + 1) for b, r in zip(bins, refs)]
            distances = [js_distance(h / n, r.word_shares) for h, r in zip(histograms, refs)]
            nearest = int(np.argmin(distances))
            counts = class_counts(content, table)
            word, char = distances[nearest], js_distance(counts / counts.sum(), refs[nearest].class_shares)
            near = word <= limits.word_distance + limits.word_distance_short / np.sqrt(n) and char <= limits.char_distance
            return (*base, not failed and (bool(near) or not own), refs[nearest].lang, word, char)

        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string(), pa.float64(), pa.float64()]
        names = [x.split()[0] for x in MEASURES.split(", ")]
        for batch in batches:
            own = [lang is None or str(lang) in known_langs for lang in batch.column(batch.num_columns - 2).to_pylist()]
            found = list(zip(*[measure(t, o) for t, o in zip(bytes_of(batch.column(batch.num_columns - 1)), own)])) or [()] * len(kinds)
            columns = batch.columns[:-2] + [pa.array(c, k) for c, k in zip(found, kinds)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-2] + names)

    return run


def _repeated_wide(ids: np.ndarray) -> int:
    """`repeated_words` for any number of different words: windows are numbered in two steps."""
    _, pairs = np.unique((ids[:-1] << 32) | ids[1:], return_inverse=True)
    _, windows, counts = np.unique((pairs[:-1].astype(np.int64) << 32) | ids[2:], return_inverse=True, return_counts=True)
    hit = counts[windows] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def measures(docs: DataFrame, limits: Limits | None = None, refs: list[Reference] | None = None) -> DataFrame:
    """One row per input row: doc_id, base measures, the nearest language and both distances, kept."""
    refs = references(docs) if refs is None else refs
    columns = (F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    texts = docs.select(*columns)
    return map_batches(texts, _measure(refs, limits or Limits()), f"doc_id bigint, {MEASURES}")


def keep_good(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The rows that pass, with the columns of the input. Rows travel with their verdict, so no join is needed."""
    run = _measure(references(docs), limits or Limits())
    names, place, lang = docs.columns, docs.columns.index("text"), docs.columns.index("lang")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        def judged(batch):
            # the text may be of a type that `measures` casts; here it is text already
            only = pa.RecordBatch.from_arrays([batch.column(lang), batch.column(place)], ["lang", "text"])
            (found,) = run(iter([only]))
            return found.column(found.schema.get_field_index("kept"))

        for batch in batches:
            yield batch.filter(pc.fill_null(judged(batch), False))

    cast = docs.withColumn("text", F.col("text").cast("string"))
    return cast.mapInArrow(passing, cast.schema).select(names)
