"""How well a 2-D projection keeps the neighbourhoods and distances of the embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mldiag.functions.columns import doubles, euclidean, ref
from mldiag.operators.blocks import CHUNK as ROWS_AT_ONCE
from mldiag.operators.blocks import away, left_rows, met, packed, squares, stacked
from mldiag.operators.neighbors import knn_join
from mldiag.operators.reduce import reduce2d
from mldiag.operators.scale import global_rank, hash_pairs, hash_sample, spread
from mldiag.session import cut_lineage

N_PAIRS = 5000
BLOCK_ROWS = 1024
CHUNK = 16
#: Cells at most, and rings of a cell (a bit each of a long).
MAX_CELLS, RINGS = 2048, 63
#: Relative rounding that bounds and ties allow for.
SLACK, TIE = 1e-9, 1e-12

Methods = Mapping[str, tuple[str, str]]


def _points(
    df: DataFrame, id_col: str, vector: str, methods: Methods, sample_size: int | None = None, seed: int = 42
) -> DataFrame:
    """(id, v, xy): all rows, or the hashed sample of them that the caller asks for."""
    coordinates = [F.array(ref(x).cast("double"), ref(y).cast("double")) for x, y in methods.values()]
    rows = df.select(
        ref(id_col).alias("id"), doubles(ref(vector)).alias("v"), F.array(*coordinates).alias("xy")
    )
    rows = rows.where(F.col("v").isNotNull())  # rows without a vector take no part
    return rows if sample_size is None else hash_sample(rows, "id", sample_size, seed)


def _distances_to(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Distances of a few rows to a block, by direct differences: equal vectors give equal distances."""
    return np.sqrt(((t[None, :, :] - q[:, None, :]) ** 2).sum(2))


def _plane_neighbors(points: DataFrame, n_methods: int, k: int, size: float, ids: tuple) -> DataFrame:
    """(id, method, rank, neighbor): the k nearest rows of every row in each projection, by one neighbour join.

    The planes stand behind one another, further apart than any two points of a plane, which leaves distances inside a plane as they are.
    Numbers take the method into the id; other ids are joined plane by plane.
    """
    low, high = ids
    numbers = isinstance(low, int) and max(abs(low), abs(high)) < (1 << 62) // n_methods
    if numbers:
        gap = 4.0 * size + 1.0
        planes = F.posexplode("xy").alias("m", "p")
        stacked = points.select("id", planes).select(
            (F.col("id") * n_methods + F.col("m")).alias("key"), F.concat(F.array(F.col("m") * gap), "p").alias("p")
        )
        found = knn_join(stacked, stacked, "key", "p", k, exclude_self=True)
        number = F.lit(n_methods).cast("bigint")
        kind = points.schema["id"].dataType
        return found.select(
            F.expr(f"id div {n_methods} - if(pmod(id, {n_methods}) > id % {n_methods}, 1, 0)").cast(kind).alias("id"),
            F.pmod("id", number).cast("int").alias("method"),
            "rank",
            F.expr(f"neighbor div {n_methods} - if(pmod(neighbor, {n_methods}) > neighbor % {n_methods}, 1, 0)").cast(kind).alias("neighbor"),
        )
    out = None
    for m in range(n_methods):
        plane = points.select("id", F.col("xy")[m].alias("p"))
        near = knn_join(plane, plane, "id", "p", k, exclude_self=True).select("id", F.lit(m).alias("method"), "rank", "neighbor")
        out = near if out is None else out.unionByName(near)
    return out


def _count_nearer(q: np.ndarray, t: np.ndarray, near: np.ndarray, slack: np.ndarray, others: np.ndarray, limits: list, ids: list, present: list) -> np.ndarray:
    """How many of `others` (in order; unknown ids last) at squared distances `near` come before each (limit, id) of a row.

    Rows that the matrix product leaves in doubt are measured directly; distances that differ by rounding alone tie, ties go by id. `present` tells
    which ids are among `others`: each is as far as its limit, and so the only one in doubt where one is.
    """
    ordered = np.sort(near, axis=1)
    out = np.empty((len(q), len(limits[0])), np.int64)
    doubt = []  # row, limit, columns
    for i in range(len(q)):
        square = limits[i] * limits[i]
        wide = square * (4 * TIE) + slack[i]
        first = np.searchsorted(ordered[i], square - wide, "left")
        last = np.searchsorted(ordered[i], square + wide, "right")
        out[i] = first
        known = {}
        for j in np.flatnonzero(last - first > present[i]).tolist():
            bounds = (first[j], last[j])
            if bounds not in known:
                known[bounds] = np.flatnonzero((near[i] >= ordered[i, bounds[0]]) & (near[i] <= ordered[i, bounds[1] - 1]))
            doubt.append((i, j, known[bounds]))
    for at in range(0, len(doubt), 4096):
        part = doubt[at : at + 4096]
        size = [len(c) for *_, c in part]
        row, column = np.repeat([i for i, *_ in part], size), np.concatenate([c for *_, c in part])
        limit = np.repeat([limits[i][j] for i, j, _ in part], size)
        d = away(q[row], t[column])
        tied = (d >= limit * (1 - TIE)) & (d <= limit * (1 + TIE))
        before = d < limit * (1 - TIE)
        if tied.any():
            wanted = np.repeat(np.array([ids[i][j] for i, j, _ in part], dtype=others.dtype), size)
            before[tied] = others[column[tied]] < wanted[tied]
        np.add.at(out, ([i for i, *_ in part], [j for _, j, _ in part]), np.add.reduceat(before, np.cumsum([0, *size[:-1]])).astype(np.int64))
    return out


def _cells(points: DataFrame, n_cells: int) -> tuple[np.ndarray, float]:
    """Pivots, and the width of the rings about them."""
    pivots = np.array([r["v"] for r in hash_sample(points, "id", n_cells).collect()], dtype=float)
    apart = _distances_to(pivots, pivots)
    typical = float(np.median(apart[apart > 0])) if (apart > 0).any() else 1.0
    return pivots, typical / 16


def neighborhood_counts(
    df: DataFrame,
    id_col: str,
    vector: str,
    methods: Methods,
    ks: Sequence[int],
    sample_size: int | None = None,
    seed: int = 42,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, method, k, n, penalty, missing) for every row (or every row of a sample that is asked for).

    `penalty` sums rank - k over projected neighbours that rank beyond k in the embedding; `missing` counts embedding neighbours
    lost by the projection. Projected neighbours come from the nearest-neighbour join. A neighbour's rank in the embedding is one
    more than the rows that are nearer: range counting. Rows are grouped into cells by their nearest pivot, and into rings by their
    distance to it. By the triangle inequality a ring is wholly nearer than a limit or wholly beyond it for most rows; it is counted from
    a small table then. A row is sent to a cell only for the rings that a limit of its cuts, and only those are read. On clustered vectors
    that leaves little of all pairs; in high dimension without clusters every row still meets every other. Blocks of rows are read past one
    another where they lie (`blocks.met`): no row is copied for each cell.
    """
    spark = df.sparkSession
    points = cut_lineage(_points(df, id_col, vector, methods, sample_size, seed))
    kind = points.schema["id"].dataType.simpleString()
    schema = f"id {kind}, method string, k int, n bigint, penalty bigint, missing bigint"
    reach = F.max(F.array_max(F.transform(F.flatten("xy"), lambda x: F.abs(x))))
    n, low, high, size = points.agg(F.count(F.lit(1)), F.min("id"), F.max("id"), reach).first()
    ks = sorted(int(k) for k in ks if 0 < k < n)
    if not ks:
        return spark.createDataFrame([], schema)
    names, most = list(methods), ks[-1]
    near = _plane_neighbors(points, len(names), most, float(size or 0.0), (low, high))
    if n <= 4 * block_rows:
        totals = _ranks_at_once(points, near, kind)
    else:
        lists = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("method", "rank", "neighbor"))).alias("near"))  # methods x k
        wanted = points.select("id", "v").join(lists, "id").select("id", "v", F.col("near.neighbor").alias("ids"))
        block_rows *= 4  # what tasks hold of either side
        asking = _limits(points, wanted, n, kind, block_rows)
        ranks = F.array(*[F.sum(F.get("nearer", F.lit(i))) + 1 for i in range(len(names) * most)])
        totals = _ranks_by_range(points, asking, n, kind, block_rows).groupBy("id").agg(ranks.alias("ranks"))
    zero = "cast(0 as bigint)"
    cells = []
    for m, name in enumerate(names):
        for k in ks:
            over = f"filter(slice(ranks, {m * most + 1}, {k}), r -> r > {k})"
            cells.append(
                F.struct(
                    F.lit(name).alias("method"),
                    F.lit(k).alias("k"),
                    F.lit(n).cast("bigint").alias("n"),
                    F.expr(f"aggregate({over}, {zero}, (s, r) -> s + r - {k})").alias("penalty"),
                    F.expr(f"cast(size({over}) as bigint)").alias("missing"),
                )
            )
    return totals.select("id", F.inline(F.array(*cells)))


def reached_cells(points: DataFrame, asking: DataFrame, n: int, kind: str, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(id, v, limits, ids, nearer, cells, rings) and the placed points (other, ov, cell, ring): which rings of which cells each row reads
    (a bit a ring), and how many rows of the others are nearer than its limits."""
    n_cells = min(MAX_CELLS, max(1, -(-n // block_rows)))
    pivots, step = _cells(points, n_cells)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = np.concatenate([_distances_to(q[None, :], pivots) for q in np.stack(batch["ov"].to_numpy())])
                cell = d.argmin(1)
                own = d[np.arange(len(cell)), cell]
                yield batch.assign(cell=cell, ring=np.minimum(own / step, RINGS - 1).astype(int), d=own)

    named = points.select(F.col("id").alias("other"), F.col("v").alias("ov"))
    placed = cut_lineage(named.mapInPandas(place, f"other {kind}, ov array<double>, cell int, ring int, d double"))
    table = placed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).collect()
    table.sort(key=lambda r: (r["cell"], r["ring"]))
    cell, ring, count = (np.array([r[c] for r in table]) for c in ("cell", "ring", "n"))
    kinds, starts = np.unique(cell, return_index=True)
    bit = np.int64(1) << ring.astype(np.int64)
    low, high = (np.array([r[c] for r in table]) for c in ("low", "high"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for v, limits in zip(batch["v"], batch["limits"]):
                every = _distances_to(np.asarray(v, dtype=float)[None, :], pivots)[0]
                home = every.argmin()
                own = (cell == home) & (ring == min(int(every[home] / step), RINGS - 1))
                to = every[cell]
                near = np.maximum(np.maximum(to - high, low - to), 0) * (1 - SLACK)
                far = (to + high) * (1 + SLACK)
                ordered = np.sort(limits)
                cut = np.searchsorted(ordered, far, "right") > np.searchsorted(ordered, near, "left")
                whole = np.flatnonzero(~cut)
                steps = np.zeros(len(ordered) + 1, np.int64)
                np.add.at(steps, np.searchsorted(ordered, far[whole], "right"), (count - own)[whole])  # the row itself aside; nearer than all limits from there on
                inside = np.cumsum(steps)[np.searchsorted(ordered, limits, "left")]
                bits = np.bitwise_or.reduceat(np.where(cut, bit, 0), starts)
                out.append((inside.tolist(), kinds[bits != 0].tolist(), bits[bits != 0].tolist()))
            columns = list(zip(*out)) or [(), (), ()]
            yield batch.assign(nearer=list(columns[0]), cells=list(columns[1]), rings=list(columns[2]))

    wide = f"id {kind}, v array<double>, limits array<double>, ids array<{kind}>, nearer array<bigint>, cells array<int>, rings array<bigint>"
    return cut_lineage(asking.mapInPandas(ask, wide)), placed


def _ranks_at_once(points: DataFrame, near: DataFrame, kind: str) -> DataFrame:
    """(id, ranks) where all points are a few blocks, which every batch of rows can meet."""
    rows = points.select("id", "v").orderBy("id").collect()
    others, t = np.array([r["id"] for r in rows]), np.array([r["v"] for r in rows], dtype=float)
    lists = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("method", "rank", "neighbor"))).alias("near"))

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for at in range(0, len(batch), CHUNK):
                part = batch.iloc[at : at + CHUNK]
                own = np.searchsorted(others, part["id"].to_numpy())
                for d, i, ids in zip(_distances_to(t[own], t), own, part["ids"]):
                    d[i] = np.inf
                    seat = np.empty(len(d), np.int64)
                    seat[np.argsort(d, kind="stable")] = np.arange(1, len(d) + 1)  # ties go by id
                    out.append(seat[np.searchsorted(others, np.asarray(ids, dtype=others.dtype))].tolist())
            yield pd.DataFrame({"id": batch["id"], "ranks": out})

    asking = spread(lists.select("id", F.col("near.neighbor").alias("ids")), "id")
    return asking.mapInPandas(rank, f"id {kind}, ranks array<bigint>")


class _ByName:
    """Rows of a block in the order of their ids, those without one last, so that ids are found by bisection."""

    def __init__(self, ids: np.ndarray, *columns: np.ndarray):
        blank = pd.isna(ids)
        order = np.concatenate([np.flatnonzero(~blank)[np.argsort(ids[~blank], kind="stable")], np.flatnonzero(blank)])
        self.ids, self.columns = ids[order], [c[order] for c in columns]
        self.known = self.ids[: len(ids) - int(blank.sum())]

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (exclusive) of each id."""
        wanted = np.asarray(wanted, dtype=self.ids.dtype)
        return np.searchsorted(self.known, wanted, "left"), np.searchsorted(self.known, wanted, "right")


def _limits(points: DataFrame, wanted: DataFrame, n: int, kind: str, block_rows: int) -> DataFrame:
    """(id, v, limits, ids): distances to the rows named by `ids`, whose blocks are read past those of the asking rows."""

    def asked(frame: pd.DataFrame) -> tuple:
        return frame["id"].to_numpy(), stacked(frame["v"]), [np.asarray(x) for x in frame["ids"]]

    def held(frame: pd.DataFrame) -> tuple:
        return frame["id"].to_numpy(), stacked(frame["v"])

    class Asking:
        def __init__(self, number: int, payload: tuple):
            self.own, self.q, self.ids = payload
            self.flat, self.row = np.concatenate(self.ids), np.repeat(np.arange(len(self.ids)), [len(x) for x in self.ids])
            self.limits = np.full(len(self.flat), np.nan)

        def meet(self, number: int, key: int, load: Callable) -> None:
            right = _ByName(*load())
            if len(right.known):
                first, last = right.find(self.flat)
                hit = np.flatnonzero((last > first) & np.isnan(self.limits))
                self.limits[hit] = away(self.q[self.row[hit]], right.columns[0][first[hit]])

        def result(self) -> pd.DataFrame:
            ends = np.cumsum([len(x) for x in self.ids])[:-1]
            return pd.DataFrame({"id": self.own, "v": list(self.q), "limits": np.split(self.limits, ends), "ids": self.ids})

    left = packed(wanted, asked, n, left_rows(points.sparkSession, n, block_rows), [F.col("id")])
    right = packed(points.select("id", "v"), held, n, block_rows, [F.col("id")])
    return met(left, right, Asking, f"id {kind}, v array<double>, limits array<double>, ids array<{kind}>")


def _ranks_by_range(points: DataFrame, asking: DataFrame, n: int, kind: str, block_rows: int) -> DataFrame:
    """(id, nearer): parts of the counts of rows nearer than each limit, to be added up."""
    asked, placed = reached_cells(points, asking, n, kind, block_rows)
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("n")).collect()  # a row a cell
    blocks = F.create_map(*[F.lit(x) for r in sizes for x in (r["cell"], r["n"])])
    spot = max(r["cell"] for r in sizes) + 1

    def question(frame: pd.DataFrame) -> tuple:
        rings = np.zeros((len(frame), spot), np.int64)
        for row, cells, bits in zip(rings, frame["cells"], frame["rings"]):
            row[np.asarray(cells, int)] = bits
        return frame["id"].to_numpy(), stacked(frame["v"]), [np.asarray(x) for x in frame["limits"]], [np.asarray(x) for x in frame["ids"]], rings

    def held(frame: pd.DataFrame) -> tuple:
        return frame["other"].to_numpy(), stacked(frame["ov"]), frame["ring"].to_numpy().astype(np.int64)

    class Asking:
        def __init__(self, number: int, payload: tuple):
            self.own, self.q, self.limits, self.ids, self.rings = payload
            self.sums = [np.zeros(len(x), np.int64) for x in self.limits]

        def meet(self, number: int, key: int, load: Callable) -> None:
            rows = np.flatnonzero(self.rings[:, key])
            if not len(rows):
                return
            right = _ByName(*load())
            t, ring = right.columns
            middle = t.mean(0)
            first, last = right.find(self.own[rows]) if len(right.known) else (np.zeros(len(rows), int),) * 2
            some = np.bitwise_or.reduce(np.int64(1) << ring)
            for at in range(0, len(rows), ROWS_AT_ONCE):
                part = rows[at : at + ROWS_AT_ONCE]
                near, slack = squares(self.q[part] - middle, t - middle)
                near = np.maximum(near, 0.0)
                for i in np.flatnonzero(self.rings[part, key] & some != some).tolist():  # rings that are counted as a whole, or not at all
                    near[i, (self.rings[part[i], key] >> ring) & 1 == 0] = np.inf
                for i in np.flatnonzero(last[at : at + len(part)] > first[at : at + len(part)]).tolist():
                    near[i, first[at + i] : last[at + i]] = np.inf  # the row itself
                sizes = [len(self.ids[i]) for i in part]
                named = np.concatenate([self.ids[i] for i in part])
                if len(right.known):
                    begin, end = right.find(named)
                    place = np.minimum(begin, len(t) - 1)
                    here = (end - begin == 1) & np.isfinite(near[np.repeat(np.arange(len(part)), sizes), place])
                else:
                    here = np.zeros(len(named), bool)
                present = np.split(here.astype(int), np.cumsum(sizes)[:-1])
                counts = _count_nearer(self.q[part], t, near, slack, right.ids, [self.limits[i] for i in part], [self.ids[i] for i in part], present)
                for i, c in zip(part.tolist(), counts):
                    self.sums[i] += c

        def result(self) -> pd.DataFrame:
            return pd.DataFrame({"id": self.own, "nearer": self.sums})

    left = packed(asked.select("id", "v", "limits", "ids", "cells", "rings"), question, n, left_rows(points.sparkSession, n, block_rows), [F.col("id")])
    right = packed(placed.select("other", "ov", "cell", "ring"), held, n, block_rows, [F.col("cell"), F.pmod(F.xxhash64("other"), blocks[F.col("cell")])], "cell")
    counted = met(left, right, Asking, f"id {kind}, nearer array<bigint>")
    return counted.unionByName(asked.select("id", "nearer"))


def stress_sums(points: DataFrame, methods: Methods, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(method, d2, e2): squared original distances and squared errors over all pairs, each pair twice.

    Every row is compared with every other by definition, a block with the blocks that are read past it; each leaves one row.
    """
    names = list(methods)
    n = points.count()

    def form(frame: pd.DataFrame) -> tuple:
        return stacked(frame["v"]), np.stack([np.stack(x) for x in frame["xy"]])

    def apart(q: np.ndarray, t: np.ndarray) -> np.ndarray:
        near, _ = squares(q, t)
        d = np.sqrt(np.maximum(near, 0.0))
        row, column = np.nonzero(near <= 1e-6 * ((q * q).sum(1) + (t * t).sum(1).max())[:, None])
        d[row, column] = away(q[row], t[column])  # where the product has few digits left; equal vectors have distance 0
        return d

    class Sums:
        def __init__(self, number: int, payload: tuple):
            self.number, (self.q, self.qxy) = number, payload
            self.d2, self.e2 = 0.0, np.zeros(len(names))

        def meet(self, number: int, key: int, load: Callable) -> None:
            if number != self.number and (number > self.number) == bool((number + self.number) % 2):
                return  # the other block meets this one
            t, txy = load()
            twice = 1.0 if number == self.number else 2.0
            middle, shift = t.mean(0), np.nan_to_num(txy.mean(0))
            for at in range(0, len(self.q), ROWS_AT_ONCE):
                d = apart(self.q[at : at + ROWS_AT_ONCE] - middle, t - middle)
                self.d2 += twice * float((d**2).sum())
                for m in range(len(names)):
                    self.e2[m] += twice * float(((d - apart(self.qxy[at : at + ROWS_AT_ONCE, m] - shift[m], txy[:, m] - shift[m])) ** 2).sum())

        def result(self) -> pd.DataFrame:
            return pd.DataFrame({"d2": [self.d2], "e2": [self.e2]})

    rows = points.select("id", "v", "xy")
    blocks = packed(rows, form, n, left_rows(points.sparkSession, n, block_rows), [F.col("id")])
    sums = met(blocks, blocks, Sums, "d2 double, e2 array<double>")
    each = [F.struct(F.lit(name).alias("method"), F.get("e2", F.lit(m)).alias("e2")) for m, name in enumerate(names)]
    return sums.select("d2", F.inline(F.array(*each))).groupBy("method").agg(F.sum("d2").alias("d2"), F.sum("e2").alias("e2"))


def quality_curves(
    df: DataFrame,
    id_col: str,
    vector: str,
    methods: Methods,
    k_max: int = 50,
    sample_size: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """(method, k, trustworthiness, continuity) for k = 5, 10, ... while k < n / 2."""
    n = df.count() if sample_size is None else min(sample_size, df.count())
    ks = [k for k in range(5, min(k_max, n - 1), 5) if 2 * k < n]
    counts = neighborhood_counts(df, id_col, vector, methods, ks, sample_size, seed)
    return _scores(counts).select("method", "k", "trustworthiness", "continuity")


def _scores(counts: DataFrame) -> DataFrame:
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    trust = 1 - 2.0 / (n * k * (2 * n - 3 * k - 1)) * F.col("penalty")
    sums = counts.groupBy("method", "k", "n").agg(F.sum("penalty").alias("penalty"), F.sum("missing").alias("missing"))
    return sums.select(
        "method", "k", "n", F.round(trust, 6).alias("trustworthiness"), F.round(1 - F.col("missing") / (n * k), 6).alias("continuity")
    )


def quality_metrics(
    df: DataFrame,
    id_col: str,
    vector: str,
    x: str = "x",
    y: str = "y",
    k: int = 10,
    sample_size: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """One row: trustworthiness and all-pairs Kruskal stress of all rows (or of a sample), their number and the k used.

    Below four rows every neighbour is a neighbour, and trustworthiness is 1 by definition.
    """
    n = df.count() if sample_size is None else min(sample_size, df.count())
    used = min(k, max(1, n // 2 - 1))
    counts = neighborhood_counts(df, id_col, vector, {"m": (x, y)}, [used], sample_size, seed)
    trust = F.lit(1.0) if n < 4 else F.col("trustworthiness")
    points = cut_lineage(_points(df, id_col, vector, {"m": (x, y)}, sample_size, seed))
    ratio = F.when(F.col("d2") > 0, F.sqrt(F.try_divide(F.col("e2"), F.col("d2")))).otherwise(0.0)
    stress = stress_sums(points, {"m": (x, y)}).select("method", F.round(ratio, 6).alias("stress"))
    scores = _scores(counts).join(stress, "method")  # one row each
    return scores.select(
        trust.alias("trustworthiness"), "stress", F.col("n").alias("n_samples"), F.lit(used).alias("k")
    )


def sampled_pairs(
    df: DataFrame,
    id_col: str,
    vector: str,
    methods: Methods,
    n_pairs: int = N_PAIRS,
    sample_size: int | None = None,
    seed: int = 42,
    upper: bool = False,
) -> DataFrame:
    """(pair_id, i, j, original, d_<method>...): distances of pseudo-random pairs of rows, numbered in id order.

    With `upper` only pairs i < j are kept, from twice as many draws.
    """
    rows = _points(df, id_col, vector, methods, sample_size, seed)
    ranks = global_rank(rows.select("id"), "id", "pos").withColumn("pos", F.col("pos") - 1)
    points = cut_lineage(rows.join(ranks, "id"))
    n = points.agg(F.count(F.lit(1)).alias("n")).scalar()
    pairs = hash_pairs(df.sparkSession, 2 * n_pairs if upper else n_pairs, n, seed)
    if upper:
        pairs = pairs.where(F.col("i") < F.col("j")).orderBy("pair_id").limit(n_pairs)
    left = points.select(F.col("pos").alias("i"), F.col("v").alias("vi"), F.col("xy").alias("xyi"))
    right = points.select(F.col("pos").alias("j"), F.col("v").alias("vj"), F.col("xy").alias("xyj"))
    both = pairs.join(left, "i").join(right, "j")
    projected = [
        euclidean(F.col("xyi")[m], F.col("xyj")[m]).alias(f"d_{name}")
        for m, name in enumerate(methods)
    ]
    return both.select("pair_id", "i", "j", euclidean(F.col("vi"), F.col("vj")).alias("original"), *projected)


def shepard_pairs(
    df: DataFrame,
    id_col: str,
    vector: str,
    x: str = "x",
    y: str = "y",
    n_pairs: int = N_PAIRS,
    sample_size: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """(pair_id, original, reduced) distances of sampled pairs i < j."""
    pairs = sampled_pairs(df, id_col, vector, {"m": (x, y)}, n_pairs, sample_size, seed, upper=True)
    return pairs.select(
        "pair_id", F.round("original", 6).alias("original"), F.round("d_m", 6).alias("reduced")
    )


def sampled_stress(
    df: DataFrame,
    id_col: str,
    vector: str,
    methods: Methods,
    n_pairs: int = N_PAIRS,
    sample_size: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """(method, stress, level): Kruskal stress over sampled pairs; below 0.1 green, 0.3 orange."""
    pairs = sampled_pairs(df, id_col, vector, methods, n_pairs, sample_size, seed)
    sums = pairs.agg(
        F.sum(F.col("original") * F.col("original")).alias("d2"),
        *[
            F.sum((F.col("original") - F.col(f"d_{m}")) * (F.col("original") - F.col(f"d_{m}"))).alias(f"e_{m}")
            for m in methods
        ],
    )
    rows = [
        F.struct(
            F.lit(m).alias("method"),
            F.when(F.col("d2") > 0, F.sqrt(F.try_divide(F.col(f"e_{m}"), F.col("d2"))))
            .otherwise(0.0)
            .alias("raw"),
        )
        for m in methods
    ]
    level = F.when(F.col("raw") < 0.1, "green").when(F.col("raw") < 0.3, "orange").otherwise("red")
    return sums.select(F.inline(F.array(*rows))).select(
        "method", F.round("raw", 4).alias("stress"), level.alias("level")
    )


def recommend(curves: DataFrame, stress: DataFrame) -> DataFrame:
    """(method, score, best): (mean trust + mean continuity) / 2 - 0.1 stress, the best one marked."""
    means = curves.groupBy("method").agg(
        F.avg("trustworthiness").alias("t"), F.avg("continuity").alias("c")
    )
    scored = means.join(stress, "method").select(
        "method",
        F.round((F.col("t") + F.col("c")) / 2 - 0.1 * F.col("stress"), 6).alias("score"),
    )
    # one row per reduction method
    place = F.row_number().over(Window.orderBy(F.desc("score"), "method"))
    return scored.withColumn("best", place == 1)


def reduce_with_quality(
    df: DataFrame,
    id_col: str,
    vector: str = "embedding",
    method: str = "pca",
    k: int = 10,
    sample_size: int | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """The projected table and its one-row quality metrics."""
    placed = reduce2d(df, method, vector, id_col=id_col, **options)
    return placed, quality_metrics(placed, id_col, vector, k=k, sample_size=sample_size)
