import zlib

import numpy as np
import pytest

from mldiag.llm import slots
from mldiag.llm.common import new_path


@pytest.mark.parametrize("seed", range(6))
def test_rebalancing_and_growing(seed):
    rng = np.random.default_rng(seed)
    load = np.maximum(0, rng.lognormal(6, 1.5, 1024).astype(np.int64) - 50)
    start = slots.first_map(1024, 16)
    assert (np.bincount(start) == 64).all()
    edited = slots.rebalanced(start, load, 16)
    total = np.bincount(edited, weights=load, minlength=16)
    single = np.array([np.count_nonzero(load[edited == k]) == 1 for k in range(16)])  # one huge slot alone
    assert np.ptp(total[~single]) <= 0.001 * total.mean() + 2 and (total[single] >= total[~single].max() - 2).all()
    assert (slots.rebalanced(edited, load, 16) == edited).all()
    more = slots.grown(edited, load, 16)
    assert set(more[more != edited]) <= {16} and np.bincount(more, weights=load, minlength=17)[16] >= 0.9 * total.sum() / 17


def test_assignment(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "é" * int(rng.integers(0, 3000)), "s", "x", 1) for i in range(3000)]
    rows += [(9000, None, "s", "x", 1), (9001, "", None, "x", 1), (None, "a", "s", "x", 1), (9002, "long" * 20_000, "s", "x", 1)] + rows[:5]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard string, law string, slot int").repartition(4)
    path = new_path(spark, "map")
    got = slots.assign(docs, path=path).collect()
    assert len(got) == len(rows)
    bytes_, places = {}, {}
    for r in got:
        assert 0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None and r.map_version == 1
        bytes_[r.shard] = bytes_.get(r.shard, 0) + r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    mean = sum(bytes_.values()) / 16
    assert len(bytes_) == 16 and max(bytes_.values()) - min(bytes_.values()) <= 0.002 * mean
    wanted = sorted(((i or 0), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in got) == wanted
    versions = slots.read_map(spark, path, 0).collect(), slots.read_map(spark, path).collect()
    assert [len(v) for v in versions] == [4096, 4096]
    shard_of = {r.virtual_slot: r.shard for r in versions[1]}
    assert all(shard_of[r.virtual_slot] == r.shard for r in got)
    again = slots.assign(docs.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty_table(spark):
    assert slots.assign(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
