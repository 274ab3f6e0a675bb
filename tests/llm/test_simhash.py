import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mldiag.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().translate(simhash.LOWER).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values):
    """Smallest value reachable over links of at most two bits, by a search from each value."""
    left, least = set(values), {}
    while left:
        start = min(left)
        seen, queue = {start}, [start]
        while queue:
            x = queue.pop()
            near = {y for y in left if (x ^ y).bit_count() <= 2} - seen
            seen |= near
            queue += near
        for x in seen:
            least[x] = start
        left -= seen
    return least


def grouped(spark, fps):
    distinct = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in set(fps)], "fp bigint")
    roots = {r.node: r.root for r in simhash.components(simhash.fingerprint_links(distinct)).collect()}
    sign = lambda f: int(np.uint64(f).view(np.int64))
    return {f: roots.get(sign(f), sign(f)) for f in set(fps)}


def classes(mapping):
    out = {}
    for k, v in mapping.items():
        out.setdefault(v, set()).add(k)
    return {frozenset(v) for v in out.values()}


def test_indices_meet_at_two_bits():
    table, sizes = simhash.golay_indices()
    assert sorted(set(sizes.tolist())) == [1, 6] and (sizes == 6).sum() == 1771
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = int(rng.integers(1 << 23))
        y = x
        for b in rng.integers(0, 23, 2):
            y ^= 1 << int(b)
        a = set(simhash.code_indices(np.array([x]), table, sizes)[1].tolist())
        assert a & set(simhash.code_indices(np.array([y]), table, sizes)[1].tolist())


@pytest.mark.parametrize("crowd", [0, 1500])
def test_components_equal_brute_force(spark, crowd):
    rng = np.random.default_rng(crowd)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40, dtype=np.uint64)]
    fps = set(base) | {0}
    for x in base:  # chains of small steps, and steps just too long
        for step in rng.integers(1, 5, 6):
            for b in rng.choice(64, step, replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    while len(fps) < crowd:
        x = base[0]
        for b in rng.choice(64, 2, replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    assert classes(grouped(spark, fps)) == classes(plain_components(fps))


def test_large_keys_give_the_same_components(monkeypatch):
    rng = np.random.default_rng(5)
    fps = {3}
    while len(fps) < 400:
        x = int(rng.choice(list(fps)))
        for b in rng.choice(41, 2, replace=False):
            x ^= 1 << (23 + int(b))
        fps.add(x)
    members = np.array(sorted(fps), np.uint64)
    wanted = plain_components(fps)
    table, sizes = simhash.golay_indices()
    for name in ("COMPARE_ALL", "SPLIT_KEY"):
        monkeypatch.setattr(simhash, name, 10)
        a, b = simhash.local_links(members, 0, table, sizes)
        label = dict(zip(members.tolist(), members.tolist()))
        for _ in range(400):
            for x, y in zip(a.tolist(), b.tolist()):
                label[x] = label[y] = min(label[x], label[y])
        assert label == wanted


def test_documents_by_brute_force(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 400)))) for _ in range(60)]
    texts += [texts[0], texts[0] + " end", texts[1].upper(), "\t".join(texts[2].split()), "", None, None, "  \n", " x", "a b", "A  b", "long " * 60_000]
    docs = spark.createDataFrame([(i * 7, t, None, "fp", "x") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, fp string, key string")
    docs = docs.unionByName(docs.filter("doc_id = 7"))
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.near_groups(docs).collect()]
    assert len(got) == len(texts) + 1
    fps = {i * 7: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {(d, f) for d, f, _ in got} == set(fps.items())
    least = plain_components(set(fps.values()))
    groups = {}
    for d, f in fps.items():
        groups.setdefault(least[f], []).append(d)
    assert {d: c for d, _, c in got} == {d: min(groups[least[f]]) for d, f in fps.items()}
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect()}) == sorted(min(g) for g in groups.values())


def test_rows_without_id_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "q r s t u")], "doc_id bigint, text string")
    assert sorted(r.component_id or -1 for r in simhash.near_groups(docs).collect()) == [-1, 4, 4]
    assert sorted(r.text for r in simhash.deduplicate(docs).collect()) == ["a b c d", "q r s t u"]
    none = docs.filter(F.lit(False))
    assert simhash.near_groups(none).count() == 0 and simhash.deduplicate(none).count() == 0
