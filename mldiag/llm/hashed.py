"""Hashed linear models: words looked up once, softmax regression fitted on a bounded sample."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from mldiag.llm.ragged import Numbers

MIX = np.uint64(0x9E3779B97F4A7C15)


class WordTable:
    """Numbers words (below 2^21) and keeps what `attributes` says of each; forgets all when half full."""

    LIMIT = 1 << 20

    def __init__(self, attributes: Callable[[list[bytes]], np.ndarray], width: int):
        self.attributes, self.place, self.rows = attributes, Numbers(), np.zeros((1 << 12, width), np.int64)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number, attribute rows) of at most LIMIT words."""
        if len(self.place) > min(self.LIMIT, 300_000):
            self.place = Numbers()
        place, known = self.place, len(self.place)
        at = place.of(words)
        if len(place) > known:
            new = place.order[known:]
            while len(self.rows) < len(place):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[known : len(place)] = self.attributes(new)
        return at, self.rows[at]


def mixed(hashes: np.ndarray) -> np.ndarray:
    out = hashes.astype(np.uint64) * MIX
    return out ^ (out >> np.uint64(32))


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    """Hash of each two neighbouring words."""
    return mixed(mixed(hashes[:-1]) + hashes[1:].astype(np.uint64))


@dataclass
class Linear:
    weights: np.ndarray  # buckets x classes
    bias: np.ndarray
    temperature: float = 1.0

    def shares(self, logits: np.ndarray) -> np.ndarray:
        z = (logits + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(
    rows: np.ndarray, buckets: np.ndarray, values: np.ndarray, targets: np.ndarray, size: int, steps: int = 80, rate: float = 0.1, decay: float = 1e-5
) -> Linear:
    """Softmax regression by Adam over all rows at once. An entry says that row `rows` holds `values` in `buckets`; targets
    are shares of the classes, a row each."""
    n, classes = targets.shape
    used, at = np.unique(buckets, return_inverse=True)  # only buckets that occur get weights
    weights, bias = np.zeros((len(used), classes)), np.log(targets.mean(axis=0) + 1e-6)
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros(classes), np.zeros(classes)]
    for step in range(1, steps + 1):
        logits = np.column_stack([np.bincount(rows, weights=values * weights[at, c], minlength=n) for c in range(classes)]) + bias
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = (e / e.sum(axis=1, keepdims=True) - targets) / n
        slope = np.column_stack([np.bincount(at, weights=values * error[rows, c], minlength=len(used)) for c in range(classes)]) + decay * weights
        for place, gradient in ((0, slope), (2, error.sum(axis=0))):
            state[place] += 0.1 * (gradient - state[place])
            state[place + 1] += 0.01 * (gradient**2 - state[place + 1])
            move = rate * (state[place] / (1 - 0.9**step)) / (np.sqrt(state[place + 1] / (1 - 0.99**step)) + 1e-8)
            if place == 0:
                weights -= move
            else:
                bias -= move
    full = np.zeros((size, classes), np.float32)
    full[used] = weights
    return Linear(full, bias)
