"""Quality classifier from weak labels.

Overlapping heuristics each vote good, bad or nothing on a document. Expectation-maximisation over the counts of all
vote patterns of the corpus estimates how often each heuristic's votes are right, without any true label. The posterior of a document's pattern is its soft label. On a bounded sample of documents, drawn by a
hash, a hashed linear scorer learns these labels from words and shapes alone; it scores every document.

No more than 3^heuristics pattern counts and `sample` feature lists come to the driver. Cases: a null or empty text has no features
and the votes of an empty text; rows that repeat get equal scores; an empty table has no rows and nothing is fitted. A very long text is
read whole, by itself; only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mldiag.llm import hashed
from mldiag.llm.common import bytes_of, map_batches
from mldiag.llm.divergence import SYMBOLS, duplicate_lines, repeated_words

BUCKETS = 1 << 16
SAMPLE = 6_000
SEED = 11
LABELLERS = ("odd_marks", "function_words", "repeats", "same_lines", "plain_words", "few_words", "line_ends")
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    b"the of and to a in is that it for was on with as be by this are at or from have not but they "
    b"der die und in den von zu das mit sich des auf ist im nicht dem ein eine als auch "
    b"de la le et les des en un du une que est pour qui dans par pas sur plus "
    b"el los se las del por con no su para es al lo como".split()
)
PLAIN = re.compile(rb"[(\"']*[A-Za-z\x80-\xff'-]+[.,;:!?)\"']*")
GOOD, BAD, NONE = 1, 0, 2


def _attributes(words: list[bytes]) -> np.ndarray:
    """Hash, function word, plain word, `|`, ends with two exclamation marks."""
    rows = [
        (zlib.crc32(w), w.lower().rstrip(b".,;:!?") in FUNCTION_WORDS, PLAIN.fullmatch(w) is not None, w == b"|", w.endswith(b"!!")) for w in words
    ]
    return np.array(rows, np.int64).reshape(len(words), 5)


@dataclass
class Measures:
    content: bytes
    n: int
    ids: np.ndarray
    rows: np.ndarray


class Reader:
    """Words of whole texts with their attributes."""

    def __init__(self):
        self.table = hashed.WordTable(_attributes, 5)

    def read(self, content: bytes) -> Measures:
        words = content.split()
        parts = [self.table.look_up(words[i : i + 200_000])[1] for i in range(0, len(words), 200_000)]
        rows = np.concatenate(parts) if parts else np.zeros((0, 5), np.int64)
        # repeats need one number a word: the hash, numbered within the text
        _, ids = np.unique(rows[:, 0], return_inverse=True)
        return Measures(content, len(words), ids.astype(np.int64), rows)


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NONE


def votes(m: Measures) -> list[int]:
    """One vote a heuristic, in the order of LABELLERS."""
    content, n = m.content, m.n
    size = max(1, len(content))
    symbols = (len(content) - len(content.translate(None, SYMBOLS))) / size
    letters = len(content) - len(content.translate(None, bytes(range(65, 91)) + bytes(range(97, 123))))
    capitals = (len(content) - len(content.translate(None, bytes(range(65, 91))))) / max(1, letters)
    function, plain, bars, shouts = (m.rows[:, i].sum() / max(1, n) for i in (1, 2, 3, 4))
    lines = [x for x in content.split(b"\n") if x.strip()]
    same = duplicate_lines(content) / max(1, len(lines))
    ends = sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines))
    distinct = (int(m.ids.max()) + 1) / n if n else 1.0
    repeats = repeated_words(m.ids) / max(1, n)
    odd = symbols > 0.03 or capitals > 0.4 or bars > 0.1 or shouts > 0.1
    return [
        _vote(odd, n >= 5 and symbols < 0.01 and capitals < 0.2),
        _vote(n >= 30 and function < 0.1, n >= 30 and function > 0.2),
        _vote(n >= 20 and repeats > 0.4, n >= 60 and repeats < 0.1),
        _vote(same > 0.3, len(lines) >= 3 and same == 0),
        _vote(n >= 10 and plain < 0.75, n >= 10 and plain > 0.9),
        _vote(n >= 20 and distinct < 0.35, n >= 20 and distinct > 0.5 or n >= 400),
        _vote(len(lines) >= 3 and ends < 0.3, len(lines) >= 3 and ends > 0.9),
    ]


def features(m: Measures) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of the shares of word shapes, with values; the words' part has length one."""
    if m.n == 0:
        return np.zeros(0, np.int64), np.zeros(0)
    buckets = (hashed.mixed(m.rows[:, 0]) % np.uint64(BUCKETS - 64)).astype(np.int64)
    kinds, counts = np.unique(buckets, return_counts=True)
    weight = np.log1p(counts)
    shapes = np.append(m.rows[:, 1:].mean(axis=0), min(1.0, m.n / 200))
    step = np.minimum((shapes * 10).astype(np.int64), 9) + 10 * np.arange(5)  # each share as one of ten steps
    return np.append(kinds, BUCKETS - 64 + step), np.append(weight / np.sqrt((weight**2).sum()), np.full(5, 0.5))


@dataclass
class LabelModel:
    """prior of good; chances[labeller, class, vote] among the votes given: no vote says nothing."""

    prior: float
    chances: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        place = np.arange(patterns.shape[1])
        chances = np.concatenate([self.chances, np.ones((len(self.chances), 2, 1))], axis=2)
        log = [np.log(p) + np.log(chances[place, c, patterns]).sum(axis=1) for c, p in ((0, 1 - self.prior), (1, self.prior))]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))

    @property
    def accuracy(self) -> np.ndarray:
        """Chance that a vote is right, over both classes."""
        return (1 - self.prior) * self.chances[:, 0, BAD] + self.prior * self.chances[:, 1, GOOD]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> LabelModel:
    """Fit to the counts of vote patterns, from the majority vote."""
    good, bad = (patterns == GOOD).sum(axis=1), (patterns == BAD).sum(axis=1)
    share = (good + 1.0) / (good + bad + 2.0)
    while True:
        weight = np.stack([counts * (1 - share), counts * share])
        chances = np.ones((patterns.shape[1], 2, 2))  # one vote of each kind beforehand
        for vote in range(2):
            chances[:, :, vote] += (weight @ (patterns == vote)).T
        chances /= chances.sum(axis=2, keepdims=True)
        model = LabelModel(float(np.clip(weight[1].sum() / weight.sum(), 1e-6, 1 - 1e-6)), chances)
        new = model.posterior(patterns)
        rounds -= 1
        if not rounds or np.abs(new - share).max() < 1e-9:
            return model
        share = new


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def pattern_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, votes(reader.read(t)))) for t in bytes_of(batch.column(1))], pa.string())], ["votes"])

    found = map_batches(_texts(docs), run, "votes string").groupBy("votes").agg(F.count("*").alias("n")).collect()  # 3^labellers at most
    patterns = np.array([[int(c) for c in r.votes] for r in found], np.int64).reshape(len(found), len(LABELLERS))
    return patterns, np.array([r.n for r in found], np.int64)


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, hashed.Linear] | None:
    """The label model of all documents, and the scorer fitted on about `sample` of them."""
    patterns, counts = pattern_counts(docs)
    if not len(counts):
        return None
    model = expectation_maximisation(patterns, counts)
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = _texts(docs).filter(draw < sample / int(counts.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            read = [reader.read(t) for t in bytes_of(batch.column(1))]
            found = [features(m) for m in read]
            share = model.posterior(np.array([votes(m) for m in read], np.int64).reshape(len(read), len(LABELLERS)))
            columns = [pa.array(share), pa.array([f[0].tolist() for f in found], pa.list_(pa.int64())), pa.array([f[1].tolist() for f in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["share", "buckets", "amounts"])

    rows = map_batches(chosen, run, "share double, buckets array<bigint>, amounts array<double>").toPandas()
    if not len(rows):
        return model, hashed.Linear(np.zeros((BUCKETS, 2), np.float32), np.log([1 - model.prior, model.prior]))
    sizes = rows.buckets.map(len).to_numpy()
    buckets, amounts = (np.concatenate([np.asarray(x) for x in rows[c]]) for c in ("buckets", "amounts"))
    targets = np.column_stack([1 - rows.share, rows.share])
    return model, hashed.fit(np.repeat(np.arange(len(rows)), sizes), buckets.astype(np.int64), amounts, targets, BUCKETS)


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, n_votes, posterior (of good, by the votes), score (of good, by the scorer), quality, kept."""
    found = train(docs, sample)
    if found is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    model, linear = found
    weight = (linear.weights[:, 1] - linear.weights[:, 0]).astype(np.float64)
    bias = float(linear.bias[1] - linear.bias[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            given, scores = [], []
            for text in bytes_of(batch.column(1)):
                m = reader.read(text)
                given.append(votes(m))
                buckets, amounts = features(m)
                scores.append(float((weight[buckets] * amounts).sum()) + bias)
            given = np.array(given, np.int64).reshape(len(scores), len(LABELLERS))
            score = 1 / (1 + np.exp(-np.clip(np.array(scores, float), -700, 700)))
            columns = [batch.column(0), pa.array((given != NONE).sum(axis=1)), pa.array(model.posterior(given)), pa.array(score)]
            columns += [pa.array((score >= 0.5).astype(np.int32)), pa.array(score >= 0.5)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_votes", "posterior", "score", "quality", "kept"])

    return map_batches(_texts(docs), run, SCHEMA)


SCHEMA = "doc_id bigint, n_votes bigint, posterior double, score double, quality int, kept boolean"
