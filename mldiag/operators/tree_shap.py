"""Exact interventional Shapley values of forests and boosted trees, path by path, for any number of features.

A leaf is reached if the values lie in the interval that its path leaves of each feature. Between an explained row and a background row
only three kinds of a path's features matter: those that only the row meets, those that only the background meets, and those
that both do; where neither does, no mix of the two reaches the leaf. With a of the first kind and c of the second, the leaf adds its value times
(a - 1)! c! / (a + c)! to each of the first and takes a! (c - 1)! / (a + c)! from each of the second. So a tree costs its leaves
times the background, not the coalitions of its features. Trees are exported once to tables of paths and intervals, which tasks
get whole (their size is that of the model, which the driver holds anyway); explained rows come in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mldiag.functions.columns import ref
from mldiag.operators.scale import spread
from mldiag.session import shared_folder

#: Paths x background rows that are held at once.
CELLS = 2_000_000
#: Features of a path: a bit each of a mask.
MOST = 64


@dataclass
class Paths:
    """Entries (path, feature, low, high): a row takes the path if low < value <= high for all; `values` are the leaves' outputs."""

    path: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    values: np.ndarray  # paths x outputs

    def parts(self, most: int) -> Iterator[Paths]:
        """The same paths in runs of at most `most`."""
        for start in range(0, len(self.values), most):
            stop = min(start + most, len(self.values))
            a, b = np.searchsorted(self.path, [start, stop])
            yield Paths(self.path[a:b] - start, self.feature[a:b], self.low[a:b], self.high[a:b], self.values[start:stop])


Node = tuple[int, float, int, int, Sequence[float]]  # feature (-1: leaf), threshold, left, right, outputs


def paths_of(trees: Sequence[Sequence[Node]], outputs: int) -> Paths:
    """The paths of trees given as node lists; a row goes left if its value is at most the threshold."""
    path, feature, low, high, values = [], [], [], [], []
    for nodes in trees:
        waiting: list[tuple[int, dict]] = [(0, {})]
        while waiting:
            at, bounds = waiting.pop()
            f, threshold, left, right, out = nodes[at]
            if f < 0:
                if len(bounds) > MOST:
                    raise ValueError(f"a path tests more than {MOST} features")
                for name, (a, b) in sorted(bounds.items()):
                    path.append(len(values))
                    feature.append(name)
                    low.append(a)
                    high.append(b)
                values.append(list(out))
                continue
            a, b = bounds.get(f, (-np.inf, np.inf))
            waiting.append((left, bounds | {f: (a, min(b, threshold))}))
            waiting.append((right, bounds | {f: (max(a, threshold), b)}))
    kinds = ((path, np.int64), (feature, np.int64), (low, float), (high, float))
    return Paths(*(np.array(x, k) for x, k in kinds), np.array(values, float).reshape(len(values), outputs))


def _nodes(spark, model) -> list[list[tuple]]:
    """(prediction, class counts, feature, threshold, left, right) of each tree's nodes, from the model's own table of nodes."""
    folder = shared_folder(spark, "trees")
    model.write().save(folder)
    node = "nodeData."
    rows = spark.read.parquet(f"{folder}/data").select(
        "treeID", node + "id", node + "prediction", node + "impurityStats", node + "leftChild", node + "rightChild",
        F.col("nodeData.split.featureIndex").alias("feature"), F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    ).orderBy("treeID", "id").collect()  # as many as the model has
    trees: dict[int, list[tuple]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], []).append((r["prediction"], r["impurityStats"], r["feature"], r["threshold"], r["leftChild"], r["rightChild"]))
    return [trees[t] for t in sorted(trees)]


def model_paths(spark, model, classes: Sequence[str]) -> Paths:
    """Paths of a fitted random forest (outputs: the probabilities of the classes) or of boosted trees (the margin of the second
    class; one-vs-rest: of every class)."""
    parts = getattr(model, "models", None)
    trees: list[list[Node]] = []
    n = len(classes)
    if parts is not None:
        for c, part in enumerate(parts):
            for nodes, w in zip(_nodes(spark, part), part.treeWeights):
                trees.append([(f, t, a, b, [w * p if i == c else 0.0 for i in range(n)]) for p, _, f, t, a, b in nodes])
    elif type(model).__name__.startswith("GBT"):
        for nodes, w in zip(_nodes(spark, model), model.treeWeights):
            trees.append([(f, t, a, b, [w * p if i == 1 else -w * p for i in range(n)]) for p, _, f, t, a, b in nodes])
    else:
        found, weights = _nodes(spark, model), model.treeWeights
        for nodes, w in zip(found, weights):
            share = [np.asarray(s) / max(sum(s), 1e-300) * w / sum(weights) for _, s, *_ in nodes]
            trees.append([(f, t, a, b, list(s)) for (_, _, f, t, a, b), s in zip(nodes, share)])
    return paths_of(trees, n)


def _weights() -> tuple[np.ndarray, np.ndarray]:
    """(a, c) -> what a feature that only the row meets gets, and what one that only the background meets loses."""
    gain, loss = np.zeros((MOST + 1, MOST + 1)), np.zeros((MOST + 1, MOST + 1))
    for a in range(MOST + 1):
        for c in range(MOST + 1 - a):
            if a:
                gain[a, c] = factorial(a - 1) * factorial(c) / factorial(a + c)
            if c:
                loss[a, c] = factorial(a) * factorial(c - 1) / factorial(a + c)
    return gain, loss


class _Part:
    """Paths against the background, ready for rows."""

    def __init__(self, paths: Paths, background: np.ndarray):
        self.paths = paths
        n = len(paths.values)
        self.starts = np.searchsorted(paths.path, np.arange(n))
        self.sizes = np.bincount(paths.path, minlength=n)
        self.bit = np.uint64(1) << (np.arange(len(paths.path)) - self.starts[paths.path]).astype(np.uint64)
        self.full = self.masks(np.ones(len(paths.path), bool))
        self.background = np.stack([self.masks(self.met(z)) for z in background], axis=1) if n else np.zeros((0, len(background)), np.uint64)

    def met(self, x: np.ndarray) -> np.ndarray:
        own = x[self.paths.feature]
        return (self.paths.low < own) & (own <= self.paths.high)

    def masks(self, met: np.ndarray) -> np.ndarray:
        """A bit for each entry that is met, by path."""
        sums = np.append(np.uint64(0), np.cumsum(np.where(met, self.bit, np.uint64(0)), dtype=np.uint64))  # wraps, and the difference is right
        return sums[self.starts + self.sizes] - sums[self.starts]

    def add(self, x: np.ndarray, phi: np.ndarray, gain: np.ndarray, loss: np.ndarray) -> None:
        """Adds the row's attributions to phi (features x outputs)."""
        mine = self.met(x)
        mask = self.masks(mine)[:, None]
        path, other = np.nonzero((mask | self.background) == self.full[:, None])
        own, theirs = mask[path, 0], self.background[path, other]
        a = np.bitwise_count(own & ~theirs).astype(np.int64)
        c = np.bitwise_count(theirs & ~own).astype(np.int64)
        up, down = gain[a, c], loss[a, c]
        size = self.sizes[path]
        entry = np.repeat(self.starts[path] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pair = np.repeat(np.arange(len(path)), size)
        bit = self.bit[entry]
        only = (theirs[pair] & bit) == 0  # the background misses what the row meets
        lost = ~mine[entry]
        share = np.where(mine[entry] & only, up[pair], 0.0) - np.where(lost, down[pair], 0.0)
        by_entry = np.bincount(entry, share, minlength=len(self.paths.path))
        np.add.at(phi, self.paths.feature, by_entry[:, None] * self.paths.values[self.paths.path])


def path_shap(points: DataFrame, features: Sequence[str], classes: Sequence[str], paths: Paths, rows: Sequence[Sequence[float]]) -> DataFrame:
    """Long attributions of points (id, x) to the paths' outputs, against the background `rows`."""
    background = np.asarray(rows, dtype=float)
    m, names, n_classes = len(features), list(features), len(classes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gain, loss = _weights()
        kept = None  # the only part of a model of few paths
        most = max(1, CELLS // max(1, len(background)))
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"].to_numpy()).astype(float)
            phi = np.zeros((len(x), m, n_classes))
            for part in paths.parts(most):
                ready = kept or _Part(part, background)
                kept = ready if len(paths.values) <= most else None
                for i in range(len(x)):
                    ready.add(x[i], phi[i], gain, loss)
            phi = phi.transpose(0, 2, 1) / len(background)
            yield pd.DataFrame(
                {
                    "id": np.repeat(batch["id"].to_numpy(), n_classes * m),
                    "class": np.tile(np.repeat(list(classes), m), len(batch)),
                    "feature": np.tile(names, len(batch) * n_classes),
                    "phi": phi.ravel(),
                    "value": np.repeat(x, n_classes, axis=0).ravel(),
                }
            )

    kind = points.schema["id"].dataType.simpleString()
    schema = f"id {kind}, class string, feature string, phi double, value double"
    return spread(points, "id").mapInPandas(run, schema)


def fitted_trees(scorer):
    """The tree model inside a trained scorer, or None."""
    model = getattr(getattr(scorer, "model", None), "model", None)
    inner = getattr(model, "models", [model])
    ok = bool(inner) and all(type(x).__name__ in ("RandomForestClassificationModel", "GBTClassificationModel") for x in inner)
    return model if ok else None


def tree_shap(df: DataFrame, id_col: str, scorer, rows: Sequence[Sequence[float]]) -> DataFrame:
    """Attributions of a trained forest's probabilities, or of boosted trees' margins."""
    from mldiag.operators.shap import imputed

    model = fitted_trees(scorer)
    if model is None:
        raise ValueError("method='tree' explains forests and boosted trees")
    features = list(scorer.features)
    points = imputed(df, id_col, scorer).select("id", F.array(*[ref(f) for f in features]).alias("x"))
    return path_shap(points, features, scorer.classes, model_paths(df.sparkSession, model, scorer.classes), rows)
