import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mldiag.llm import lines

STRIP = " \t\n\v\f\r"


def key_of(line):
    key = re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(STRIP))
    return key if len(key) >= 20 else None


def expected(rows):
    holders = {}
    for i, text in rows:
        for key in {key_of(x) for x in (text or "").split("\n")} - {None}:
            holders.setdefault(key, []).append(i)
    owners = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= 3}
    out = []
    for i, text in rows:
        every = (text or "").split("\n")
        kept = [x for x in every if key_of(x) not in owners or owners[key_of(x)] == i]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def table():
    rng = random.Random(4)
    shared = [f"This line number {i} is in many documents" for i in range(30)] + ["ÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ", "ÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ", "x" * 20, "x" * 19]
    rows = []
    for i in range(120):
        own = [f"own line {i} {j} " + "w" * rng.randrange(30) for j in range(rng.randrange(4))]
        some = [rng.choice([str.upper, str, lambda x: f"\t{x} \r"])(rng.choice(shared)) for _ in range(rng.randrange(5))]
        both = own + some + [""] * rng.randrange(2)
        rng.shuffle(both)
        rows.append((i, "\n".join(both)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, shared[0]), (None, "only rows without an id hold this"), (None, "only rows without an id hold this")]
    rows += [(None, "ONLY rows without an id hold this"), (203, shared[1] + "\n" + shared[1]), (203, shared[1] + "\n" + shared[1]), (204, shared[2] + "\n" + "long " * 200_000)]
    return rows


def test_lines_by_brute_force(spark):
    rows = table()
    docs = spark.createDataFrame([(i, t, 1, "x", 0) for i, t in rows], "doc_id bigint, text string, h int, lost string, d int").repartition(3)
    got = sorted((tuple(r) for r in lines.drop_lines(docs).collect()), key=str)
    assert got == expected(rows)
    kept = lines.deduplicate(docs)
    assert kept.schema == docs.schema
    texts = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str)
    assert texts == sorted(((x[0], x[3]) for x in expected(rows)), key=str)
    assert kept.filter(F.col("text").isNull()).count() == 1


@pytest.mark.parametrize(("keys", "probes"), [(4, 40), (1, 1 << 18), (1 << 15, 7)])
def test_many_shards_and_copies(spark, keys, probes):
    """Small shards, and shards that several tasks answer, give what one shard gives."""
    rows = table()
    hashes = lines.line_hashes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    whole = sorted(map(tuple, lines.lost_lines(hashes).collect()), key=str)
    assert whole and whole == sorted(map(tuple, lines.lost_lines(hashes, keys=keys, probes=probes).collect()), key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    both = np.unique(rng.integers(0, 1 << 63, (n, 2), np.uint64), axis=0)
    made = lines.PerfectHash.build(both[:, 0], both[:, 1])
    assert sorted(made.numbers(both[:, 0], both[:, 1]).tolist()) == list(range(n))
    other = rng.integers(0, 1 << 63, (500, 2), np.uint64)
    assert (made.numbers(other[:, 0], other[:, 1]) < max(n, 1)).all()
    assert made.words.nbytes * 8 <= max(5 * n, 256)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert lines.drop_lines(empty).count() == 0 and lines.deduplicate(empty).count() == 0
