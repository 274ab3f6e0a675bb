import hashlib
import random

import pytest

from mldiag.llm import exact_dedup


def plain(rows, pick):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        owner = pick(ids) if ids else None
        out.append((i, owner if len(groups[t or ""]) > 1 else i, len(groups[t or ""]), i == owner, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a"), (2, "ab"), (3, "a"), (4, None), (5, ""), (6, "é"), (7, "é"), (8, "A"), (None, "a"), (9, "x" * 300_000), (10, "x" * 300_000),
        (11, "x" * 299_999 + "y"), (12, "ab"), (12, "ab"), (13, "abc"), (14, "abd"), (None, "only"), (-5, "ab")]


@pytest.mark.parametrize("limit", [1, 600_000, exact_dedup.TRIE_BYTES])
@pytest.mark.parametrize("largest", [True, False])
def test_groups_by_brute_force(spark, limit, largest):
    docs = spark.createDataFrame([(i, t, "s", 0, "h") for i, t in ROWS], "doc_id bigint, text string, sha string, n int, owner string").repartition(3)
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(docs, largest, limit).collect()), key=str)
    wanted = plain(ROWS, max if largest else min)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in wanted]
    assert all(g[3] == (g[0] == g[1]) for g in got)
    kept = exact_dedup.deduplicate(docs, largest, limit)
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t in ROWS})


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert exact_dedup.exact_groups(docs).count() == 0 and exact_dedup.deduplicate(docs).count() == 0


def test_trie_equals_a_dictionary():
    rng = random.Random(3)
    trie, wanted = exact_dedup.PatriciaTrie(True), {}
    got = []
    for i in range(3000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randrange(2, 12)))
        trie.insert(key, (i, 1, 1))
        n, _ = wanted.get(key, (0, 0))
        wanted[key] = (n + 1, i)
        if i % 500 == 250:  # subtrees off this path leave, the path itself stays
            head = key[:2]
            for k, t in trie.take(head):
                assert not k.startswith(head)
                got.append((k, t))
    got += list(trie.take())
    merged = {}
    for k, (owner, n, _) in got:
        m = merged.get(k, (0, -1))
        merged[k] = (m[0] + n, max(m[1], owner))
    assert merged == wanted and trie.bytes == 0
