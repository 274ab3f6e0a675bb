"""Sequences of ids for words, kept flat, so that a text's ids are one gather."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of flat[start : start + length]."""
    if len(lengths) == 0:
        return flat[:0]
    ends = np.cumsum(lengths)
    return flat[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]


class Numbers(dict):
    """Numbers words as they come; `order` lists them. Known words are found without running Python code."""

    def __init__(self):
        self.order: list = []

    def __missing__(self, word):
        number = self[word] = len(self.order)
        self.order.append(word)
        return number

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Remembered:
    """Ids of words by `encode`, which gets lists of new words. Beyond `most` words those that came in one call only are forgotten."""

    def __init__(self, encode: Callable[[list[str]], list[Sequence[int]]], dtype, most: int = 250_000):
        self.encode, self.most, self.dtype = encode, most, dtype
        self.place = Numbers()
        self.flat = np.zeros(1 << 16, dtype)
        self.used = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.again = np.zeros(1 << 14, bool)

    def forget(self) -> None:
        keep = np.flatnonzero(self.again[: len(self.place)])
        if 4 * len(keep) > 3 * self.most:
            keep = keep[:0]
        known, self.place = self.place.order, Numbers()
        self.place.of([known[i] for i in keep.tolist()])
        kept, sizes = gather(self.flat, self.starts[keep], self.lengths[keep]), self.lengths[keep]
        self.used = len(kept)
        self.flat[: self.used] = kept
        self.starts[: len(keep)], self.lengths[: len(keep)] = np.cumsum(sizes) - sizes, sizes
        self.again[:] = False

    def places(self, words: list) -> np.ndarray:
        """Where the words' ids are in `starts` and `lengths`, until the next call."""
        if len(self.place) > self.most:
            self.forget()
        place, known = self.place, len(self.place)
        at = place.of(words)
        self.again[at[at < known]] = True
        if len(place) > known:
            fresh = place.order[known:]
            found = self.encode(fresh)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            total = int(sizes.sum())
            while len(self.flat) < self.used + total:
                self.flat = np.append(self.flat, np.zeros(len(self.flat), self.dtype))
            while len(self.starts) < len(place):
                self.starts = np.append(self.starts, np.zeros(len(self.starts), np.int64))
                self.lengths = np.append(self.lengths, np.zeros(len(self.lengths), np.int64))
                self.again = np.append(self.again, np.zeros(len(self.again), bool))
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), self.dtype, total)
            self.starts[known : len(place)] = self.used + np.cumsum(sizes) - sizes
            self.lengths[known : len(place)] = sizes
            self.used += total
        return at

    def ids(self, words: list) -> np.ndarray:
        at = self.places(words)
        return gather(self.flat, self.starts[at], self.lengths[at])


def blocks(items: Iterator, size: int) -> Iterator[list]:
    from itertools import islice

    while block := list(islice(items, size)):
        yield block
