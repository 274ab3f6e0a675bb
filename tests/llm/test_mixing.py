import itertools
import re

import numpy as np
import pytest

from mldiag.llm import mixing


def plain_targets(sizes):
    """Share by weight; cut at twice the size; share the excess among the others, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, out = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in out]
        left = budget - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] >= 2 * sizes[s]]
        if not above:
            return out | share
        out |= {s: 2.0 * sizes[s] for s in above}


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {f"s{i}": int(10 ** rng.uniform(0, 6)) for i in range(17)} | {None: 500, "é": 0, "": 9, "Z": 10**9}
    rows = [(("=" + s) if s is not None else "", s, n) for s, n in sizes.items()]
    df = spark.createDataFrame(rows, "key string, source string, source_size bigint")
    got = {r.key: r.target for r in mixing.source_targets(df).collect()}
    for s, t in plain_targets(sizes).items():
        assert got["=" + s if s is not None else ""] == pytest.approx(t, rel=1e-9)


@pytest.mark.parametrize("seed", range(30))
def test_fit_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.choice(np.arange(0, 40), 5, replace=False)
    counts = rng.integers(1, 4, 5)
    for goal in (0, 1, int(rng.integers(1, 200)), int((lengths * counts).sum())):
        take = mixing.fit_lengths(lengths, counts, goal)
        assert (take >= 0).all() and (take <= counts).all()
        fixed = np.minimum(counts, counts * goal // int((lengths * counts).sum()))  # the proportional part, before the programme runs
        sums = {sum(a * b for a, b in zip(c, lengths.tolist())) for c in itertools.product(*(range(int(f), n + 1) for f, n in zip(fixed, counts.tolist())))}
        assert abs(int((take * lengths).sum()) - goal) == min(abs(s - goal) for s in sums)


def test_fit_is_exact_with_many_lengths():
    rng = np.random.default_rng(1)
    lengths, counts = np.arange(3, 3000), rng.integers(1, 50, 2997)
    for goal in (77_777, 10_000_001, int((lengths * counts).sum()) - 1):
        take = mixing.fit_lengths(lengths, counts, goal)
        assert abs(int((take * lengths).sum()) - goal) <= (goal > 10**8) and (take <= counts).all()


def made(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(["w"] * int(rng.integers(0, 30))) for _ in range(600)] + [None, "", " \t", "x\x0by\x0cz é", "long " * 50_000]
    rows = [(i, t, (None, "a", "b", "é", "B")[min(i % 7, 4)], i, "c") for i, t in enumerate(texts)]
    rows += rows[:3] + [(None, "no id", "a", 1, "d")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, copies string").repartition(5), rows


def test_mix(spark):
    docs, rows = made(spark)
    got = mixing.mix_table(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals, taken = {}, {}
    for r in rows:
        totals[r[2]] = totals.get(r[2], 0) + size(r[1])
    targets = plain_targets(totals)
    of = {r[0]: r for r in rows}
    for g in got:
        source = of[g.doc_id][2]
        assert g.size == size(of[g.doc_id][1]) and g.source_size == totals[source]
        assert g.target == pytest.approx(targets[source])
        assert 0 <= g.taken <= 2 * g.size and g.taken % max(1, g.size) == 0
        taken[source] = taken.get(source, 0) + g.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 2 or t > 40_000
    again = mixing.mix_table(docs.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    stage = mixing.mix(docs)
    assert stage.columns == docs.columns
    words = {}
    for r in stage.collect():
        words[r.source] = words.get(r.source, 0) + size(r.text)
    assert words == {s: n for s, n in taken.items() if n}


def test_empty_tables(spark):
    docs, _ = made(spark)
    assert mixing.mix_table(docs.filter("false")).count() == 0 and mixing.mix(docs.filter("false")).count() == 0
    assert mixing.mix_table(docs.filter("text is null")).first().taken == 0


@pytest.mark.parametrize("seed", range(20))
def test_few_long_documents_end_at_the_nearest_sum(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.choice(np.arange(4_000, 120_000), 1 + seed % 3, replace=False)
    counts = np.ones(len(lengths), np.int64)
    cases = [(lengths, counts, int(lengths.sum() * rng.uniform(0.05, 0.95)))]
    cases += [(np.array([100_000]), np.array([1]), 90_000), (np.array([5_000]), np.array([3]), 13_500), (np.array([5_000]), np.array([1]), 3_500)]
    for lengths, counts, goal in cases:
        take = mixing.fit_lengths(lengths, counts, goal)
        sums = [sum(a * b for a, b in zip(c, lengths.tolist())) for c in itertools.product(*(range(n + 1) for n in counts.tolist()))]
        assert abs(int((take * lengths).sum()) - goal) == min(abs(s - goal) for s in sums)
