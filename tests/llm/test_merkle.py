import hashlib
import random
import zlib

import pytest

from mldiag.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    n_chars = None if n_chars is None else n_chars + more
    values = (None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text))
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree(digests):
    """All levels, two by two."""
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        other = i ^ 1
        out.append((level[other] if other < i else "", level[other] if i < other < len(level) else ""))
        i //= 2
    return out


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {name: tree([leaf(r) for r in groups[name]]) for name in names}
    top = tree([trees[name][-1][0] for name in names])
    out = []
    for g, name in enumerate(names):
        for i, row in enumerate(groups[name]):
            path = siblings(trees[name], i) + siblings(top, g)
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            folded = leaf(row, 1 if tampered else 0)
            for left, right in path:
                folded = sha(left + folded + right)
            proof = sha("".join(left + right for left, right in path))
            out.append((row[0], leaf(row), trees[name][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1, 2, 17, 300])
def test_audit_by_brute_force(spark, size):
    rng = random.Random(size)
    langs = [None, "", "de", "en", "en", "en", "é", "z"]
    rows = [(rng.choice([rng.randrange(10_000), i]), rng.choice(["a", "", None, "xé\n"]), rng.choice(langs), rng.choice([None, "web"]), rng.choice([None, 5])) for i in range(size)]
    if size > 2:
        rows += [rows[0], rows[0], (None, "n", "en", "s", 1), (None, None, None, None, None), (-4, "w " * 300_000, "en", "s", 600_000)]
    docs = spark.createDataFrame([(*r, "x", 2, "y") for r in rows], SCHEMA + ", leaf string, lo int, key string").repartition(3)
    got = merkle.audit(docs, merkle.tampering())
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_nodes_cover_intervals(spark):
    rows = [(i, f"t{i}", "en" if i < 75 else "fr", "s", 1) for i in range(80)]
    leaves = merkle.ranked(merkle.leaf_rows(spark.createDataFrame(rows, SCHEMA)), ["doc_id", "digest"])
    tables = merkle.buckets(leaves)
    nodes = merkle.nodes(tables).collect()
    for key, n in (("=en", 75), ("=fr", 5)):
        levels = tree([leaf(r) for r in rows if f"={r[2]}" == key])
        own = {(x.level, x.lo): x for x in nodes if x.key == key}
        assert len(own) == sum(map(len, levels)) == sum(x.key == key for x in nodes)
        for level, digests in enumerate(levels):
            for i, digest in enumerate(digests):
                node = own[level, i << level]
                assert node.digest == digest and node.hi == min(n, (i + 1) << level) - 1
    assert {r.key: r.root for r in merkle.roots(tables).collect()} == {x.key: x.digest for x in nodes if x.hi - x.lo + 1 == {"=en": 75, "=fr": 5}[x.key]}


def test_untampered_rows_verify(spark):
    docs = spark.createDataFrame([(i, "t", "en", "s", i) for i in range(40)], SCHEMA)
    assert merkle.audit(docs).filter("not verified").count() == 0


def test_empty_table(spark):
    assert merkle.audit(spark.createDataFrame([], SCHEMA), merkle.tampering()).count() == 0
