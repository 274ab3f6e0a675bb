"""Language identification by interpolated Kneser-Ney character models.

Each language has an order-5 character model over words with an edge mark on either side. Its n-grams are 64-bit hashes in one
sorted array an order, next to interpolated log probabilities and back-off weights, so a lookup is a binary search. A document
gets the language of the lowest cross-entropy a character. Scores and rejection are calibrated on labelled documents that
the models have not seen: a temperature turns differences of cross-entropy into a probability, and a document whose own language
finds it less likely than almost all of its kind is marked as rejected (its prediction stays).

Fitting reads at most `documents_a_language` labelled documents a language, drawn by a hash of the identifier, of every labelled language;
more than `MOST_LANGUAGES` of them are an error. Every text is scored whole. Words are scored once and remembered.

Cases: a text that is null or has no letter is `und` with score 0, and so is every text where nothing is labelled. Repeated rows
are scored one by one; a null identifier hashes like an empty one. A very long text is scored whole, in parts. An empty
table gives no rows. Other columns have no part in it, whatever they are called.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mldiag.llm.common import map_batches, texts_of
from mldiag.llm.ragged import Numbers, blocks

ORDER = 5
DOCUMENTS_A_LANGUAGE = 2_000
CALIBRATION_DOCUMENTS = 500
MOST_LANGUAGES = 1_000
REJECT_SHARE = 0.005
LETTERS = re.compile(r"[^\W\d_]+")
EDGE = 2
REMEMBERED = 200_000
LONGEST = 64
WORDS_AT_ONCE = 100_000
FRESH = 20_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIXER = np.uint64(0xBF58476D1CE4E5B9)


def ngram_hashes(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(word of each place, letters before it in the word, whether it is predicted, hashes by order) of the marked words' places.

    hashes[n - 1][i] is that of the n-gram that ends at place i; it only means something where the word has n letters by then."""
    joined = "".join(f"{chr(EDGE)}{w}{chr(EDGE)}" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    single = (codes + np.uint64(1)) * MIXER
    single ^= single >> np.uint64(29)
    hashes = [single]
    for _ in range(order - 1):
        before = np.append(np.uint64(0), hashes[-1][:-1])
        longer = (before ^ (before >> np.uint64(31))) * MULTIPLIER + single
        hashes.append(longer)
    return word, place, place > 0, hashes


def _sampled(docs: DataFrame, bound: int, salt: int, counts: dict[str, int]) -> DataFrame:
    """About `bound` rows a language, by a hash of the identifier."""
    if not counts:
        return docs.filter(F.lit(False))
    share: Column | None = None
    for lang, n in sorted(counts.items()):
        hit = F.col("lang") == lang
        share = F.when(hit, min(1.0, bound / n)) if share is None else share.when(hit, min(1.0, bound / n))
    draw = F.pmod(F.xxhash64(F.lit(salt), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    return docs.filter(draw < share.otherwise(0.0))


def word_blocks(text: str) -> Iterator[list[str]]:
    """Lower-case runs of letters, long ones cut, in blocks; none if no character of the text is a letter."""
    text = text.lower()
    if len(text) <= 1 << 20:
        found = iter([LETTERS.findall(text)])
    else:
        found = blocks((m.group() for m in LETTERS.finditer(text)), WORDS_AT_ONCE)
    letters = False  # the runs also hold marks like one half, which are none
    for words in found:
        letters = letters or any(c.isalpha() for w in words for c in w)
        if letters:
            if max(map(len, words)) > LONGEST:
                words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
            yield words


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def rows() -> pa.RecordBatch:
        out = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        counts.clear()
        columns = list(zip(*out)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            for words in word_blocks(text):
                counts.setdefault(lang, Counter()).update(words)
            if sum(map(len, counts.values())) > 100_000:
                yield rows()
    yield rows()


def _count_ngrams(order: int):
    """n-grams of the words with their counts; a word's n-grams are summed within a batch of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            words, counts = batch.column(1).to_pylist(), np.asarray(batch.column(2))
            for lang in sorted(set(langs.tolist())):
                mine = np.flatnonzero(langs == lang)
                word, place, _, hashes = ngram_hashes([words[i] for i in mine.tolist()], order)
                n = counts[mine][word]
                for size in range(1, order + 1):
                    there = place >= size - 1
                    if size == 1:
                        there &= place > 0  # the mark in front is never predicted
                    own = hashes[size - 1][there]
                    shorter = hashes[size - 2][there] if size > 1 else np.zeros(len(own), np.uint64)
                    context = np.append(np.uint64(0), hashes[size - 2][:-1])[there] if size > 1 else np.zeros(len(own), np.uint64)
                    first = place[there] == size - 1  # begins with the mark
                    keys, index, inverse = np.unique(own, return_index=True, return_inverse=True)
                    total = np.bincount(inverse, weights=n[there]).astype(np.int64)
                    columns = [
                        pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), size, np.int32)), pa.array(keys.view(np.int64)),
                        pa.array(context[index].view(np.int64)), pa.array(shorter[index].view(np.int64)), pa.array(first[index]), pa.array(total),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "size", "ngram", "context", "shorter", "first", "n"])

    return run


def _estimate(order: int):
    """Interpolated Kneser-Ney: the longest n-grams and those at a word's start by their counts, others by the letters before them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        by_size = {size: part.sort_values("ngram", key=lambda s: s.to_numpy().view(np.uint64), ignore_index=True) for size, part in rows.groupby("size")}
        out = []
        for size in range(1, order + 1):
            if size not in by_size:
                break
            part = by_size[size]
            keys = part.ngram.to_numpy().view(np.uint64)
            count = part.n.to_numpy().astype(float)
            if size < order and size + 1 in by_size:
                longer = by_size[size + 1].shorter.to_numpy().view(np.uint64)
                kinds = np.bincount(np.searchsorted(keys, longer[np.isin(longer, keys)]), minlength=len(keys))
                count = np.where(part["first"].to_numpy() & (size > 1), count, np.maximum(kinds, 1))
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            contexts, inverse = np.unique(part.context.to_numpy().view(np.uint64), return_inverse=True)
            total = np.bincount(inverse, weights=count)
            kinds = np.bincount(inverse)
            rest = discount * kinds / total  # what the discounts leave for shorter n-grams
            own = np.maximum(count - discount, 0) / total[inverse]
            if size == 1:
                p = own + rest[inverse] / (len(keys) + 1)
                unseen = rest[0] / (len(keys) + 1)
                out.append(pd.DataFrame({"size": 0, "ngram": [0], "logp": np.log(unseen), "backoff": 0.0}))
            else:
                below = by_size[size - 1]
                at = np.searchsorted(below.ngram.to_numpy().view(np.uint64), part.shorter.to_numpy().view(np.uint64))
                p = own + rest[inverse] * below.p.to_numpy()[at]
                held = np.searchsorted(below.ngram.to_numpy().view(np.uint64), contexts)  # every context is an n-gram of its own
                out[-1].loc[held, "backoff"] = np.log(rest)
            part["p"] = p
            out.append(pd.DataFrame({"size": size, "ngram": keys.view(np.int64), "logp": np.log(p), "backoff": 0.0}))
        table = pd.concat(out, ignore_index=True)
        table.insert(0, "lang", rows.lang.iloc[0])
        return table

    return run


@dataclass
class CharacterModel:
    """Sorted hashes by order, with log probabilities (nan for a mere context) and back-off weights."""

    lang: str
    hashes: list[np.ndarray]
    logp: list[np.ndarray]
    backoff: list[np.ndarray]
    unseen: float

    def find(self, size: int, keys: np.ndarray) -> np.ndarray:
        table = self.hashes[size - 1]
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, at, -1)

    def word_scores(self, n_words: int, word: np.ndarray, place: np.ndarray, unique: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log probability of each word's letters and end mark. unique: by order, distinct hashes and the place of each."""
        order = len(self.hashes)
        found = []
        for size in range(1, order + 1):
            keys, inverse = unique[size - 1]
            at = self.find(size, keys)
            logp = np.where(at >= 0, self.logp[size - 1][at], np.nan)
            back = np.where(at >= 0, self.backoff[size - 1][at], 0.0)
            found.append((logp[inverse], back[inverse]))
        score = np.full(len(place), self.unseen)
        for size in range(1, order + 1):
            there = place >= max(1, size - 1)
            if size > 1:  # longer n-grams take over where they are known; else their context's weight is added
                context = np.append(0.0, found[size - 2][1][:-1])
                score = np.where(there, score + context, score)
            score = np.where(there & ~np.isnan(found[size - 1][0]), found[size - 1][0], score)
        return np.bincount(word, weights=np.where(place > 0, score, 0.0), minlength=n_words)


class Scorer:
    """Cross-entropies of whole texts under all models; distinct words are scored once."""

    def __init__(self, models: list[CharacterModel]):
        self.models, self.place, self.scores = models, Numbers(), np.zeros((1 << 12, len(models)))

    def fresh(self, words: list[str]) -> np.ndarray:
        order = len(self.models[0].hashes)
        word, place, _, hashes = ngram_hashes(words, order)
        unique = [np.unique(h, return_inverse=True) for h in hashes]
        return np.column_stack([m.word_scores(len(words), word, place, unique) for m in self.models])

    def entropies(self, texts: Iterable[str]) -> list[tuple[np.ndarray, int] | None]:
        """Of each text the nats a character under each model and the number of characters; None if it has no letter.

        Texts are read first; then the words that none of them had before are scored together."""
        if len(self.place) > REMEMBERED:
            self.place = Numbers()
        place, known = self.place, len(self.place)
        read = []
        for text in texts:
            parts, letters = [], 0
            for block in word_blocks(text):
                parts.append(place.of(block).astype(np.int32))
                letters += sum(map(len, block)) + len(block)
            read.append((parts, letters))
        while len(self.scores) < len(place):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        for at in range(known, len(place), FRESH):
            new = place.order[at : at + FRESH]
            self.scores[at : at + len(new)] = self.fresh(new)
        return [
            (-sum(self.scores[part].sum(axis=0) for part in parts) / letters, letters) if letters else None for parts, letters in read
        ]


def probabilities(entropies: np.ndarray, letters: np.ndarray, temperature: float) -> np.ndarray:
    """Share of each language (columns): differences of cross-entropy times the square root of the length, scaled."""
    z = -(entropies - entropies.min(axis=1, keepdims=True)) * temperature * np.sqrt(letters)[:, None]
    e = np.exp(np.maximum(z, -700))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Identifier:
    """What fitting found: models, the temperature and each language's highest accepted cross-entropy."""

    models: list[CharacterModel]
    temperature: float
    highest: np.ndarray


def _to_models(table: pd.DataFrame, order: int) -> list[CharacterModel]:
    models = []
    for lang, rows in table.groupby("lang", sort=True):
        hashes, logp, backoff = [], [], []
        for size in range(1, order + 1):
            part = rows[rows["size"] == size]
            keys = part.ngram.to_numpy().view(np.uint64)
            ordered = np.argsort(keys, kind="stable")
            empty = len(keys) == 0
            hashes.append(np.zeros(1, np.uint64) if empty else keys[ordered])
            logp.append(np.full(1, np.nan) if empty else part.logp.to_numpy()[ordered])
            backoff.append(np.zeros(1) if empty else part.backoff.to_numpy()[ordered])
        models.append(CharacterModel(str(lang), hashes, logp, backoff, float(rows[rows["size"] == 0].logp.iloc[0])))
    return models


def fit(
    learn: DataFrame,
    order: int = ORDER,
    documents_a_language: int = DOCUMENTS_A_LANGUAGE,
    calibration_documents: int = CALIBRATION_DOCUMENTS,
) -> Identifier | None:
    """Models of the labelled rows (doc_id, text, lang), one for each language; raises if there are more than MOST_LANGUAGES."""
    labelled = learn.filter("lang is not null and text is not null")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labelled languages: their models don't fit into a worker; join or drop labels first")
    if not counts:
        return None
    calibrating = F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(5)) == 0
    small = {k for k, n in counts.items() if n < 20}  # too few to set some aside
    aside = calibrating & ~F.col("lang").isin(*small) if small else calibrating
    words = map_batches(_sampled(labelled.filter(~aside), documents_a_language, 1, counts).select("lang", "text"), _count_words, "lang string, word string, n bigint")
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    ngrams = map_batches(words, _count_ngrams(order), "lang string, size int, ngram bigint, context bigint, shorter bigint, first boolean, n bigint")
    key = ("lang", "size", "ngram")
    ngrams = ngrams.groupBy(*key).agg(F.min("context").alias("context"), F.min("shorter").alias("shorter"), F.max("first").alias("first"), F.sum("n").alias("n"))
    # a language's n-grams come from a bounded number of documents
    models = _to_models(ngrams.groupBy("lang").applyInPandas(_estimate(order), "lang string, size int, ngram bigint, logp double, backoff double").toPandas(), order)
    if not models:
        return None
    held = _sampled(labelled.filter(calibrating), calibration_documents, 2, counts)
    langs = [m.lang for m in models]
    scored = held.select("lang", "text").mapInArrow(_calibration(models), "lang string, letters bigint, entropies array<double>").toPandas()
    scored = scored[scored.lang.isin(langs)]
    if not len(scored):
        return Identifier(models, 10.0, np.full(len(models), np.inf))
    entropies, letters = np.array(scored.entropies.tolist()), scored.letters.to_numpy()
    truth = np.array([langs.index(x) for x in scored.lang])
    grid = 2.0 ** np.arange(-4, 9)
    rows = np.arange(len(truth))
    loss = [-np.log(np.maximum(probabilities(entropies, letters, t)[rows, truth], 1e-9)).mean() for t in grid]
    highest = np.array([np.quantile(entropies[truth == i, i], 1 - REJECT_SHARE) if (truth == i).any() else np.inf for i in range(len(models))])
    return Identifier(models, float(grid[int(np.argmin(loss))]), highest)


def _calibration(models: list[CharacterModel]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models)
        for batch in batches:
            out = []
            for lang, found in zip(batch.column(0).to_pylist(), scorer.entropies(texts_of(batch.column(1)))):
                if found is not None:
                    out.append((lang, found[1], found[0].tolist()))
            columns = list(zip(*out)) or [()] * 3
            kinds = (pa.string(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "letters", "entropies"])

    return run


def predict(docs: DataFrame, identifier: Identifier | None) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy (nats a character) and rejected, from the text alone."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(identifier.models) if identifier else None
        names = ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"]
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
        for batch in batches:
            out = []
            for found in scorer.entropies(texts_of(batch.column(1))) if scorer else [None] * batch.num_rows:
                if found is None:
                    out.append(("und", 0.0, None, True))
                    continue
                entropies, letters = found
                best = int(entropies.argmin())
                share = float(probabilities(entropies[None, :], np.array([letters]), identifier.temperature)[0, best])
                rejected = bool(entropies[best] > identifier.highest[best])
                out.append((identifier.models[best].lang, share, float(entropies[best]), rejected))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return map_batches(rows, run, "doc_id bigint, lang_pred string, score double, cross_entropy double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, cross_entropy, rejected. Documents whose crc32(doc_id as text) mod 3 is 1
    are held out; the others' text and lang are what is learned from."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    out = held_out(F.col("doc_id"))
    found = predict(rows, fit(rows.filter(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3 == 1
