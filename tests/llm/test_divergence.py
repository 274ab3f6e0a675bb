import math
import os
import re
from collections import Counter

import numpy as np
import pytest

from mldiag.llm import divergence

FOLDER = "/root/testdata/sf0.01"


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


TEXTS = [None, "", " \n\t", "a", "a a a a", "a b c\na b c\n\n \n \na b c \nx", "é ü # ü\x85b c", "#|<> " * 30, "word " * 60,
         " ".join(f"w{i}" for i in range(200)), "x" * 200_000, "a b c " * 40_000]


def test_base_measures_by_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, True, 1) for i, t in enumerate(TEXTS * 2)], "doc_id bigint, text string, lang string, kept boolean, n_words int")
    rows = {r.doc_id: r for r in divergence.measures(docs).collect()}
    assert len(rows) == 2 * len(TEXTS)
    for i, t in enumerate(TEXTS * 2):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_base(t), repr(t)[:40]
        assert not (r.base_failed and r.kept)
    assert divergence.keep_good(docs).columns == docs.columns
    assert divergence.measures(docs.filter("false")).count() == 0 and divergence.keep_good(docs.filter("false")).count() == 0


def test_many_different_words(monkeypatch):
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 500, 3000), np.arange(100)])
    windows = Counter(zip(ids, ids[1:], ids[2:]))
    covered = {i + k for i, w in enumerate(zip(ids, ids[1:], ids[2:])) if windows[w] > 1 for k in range(3)}
    assert divergence.repeated_words(ids) == divergence._repeated_wide(ids) == len(covered)


def test_distance():
    def plain(p, q):
        return math.sqrt(sum(x * math.log2(2 * x / (x + y)) for x, y in zip(p, q) if x) / 2 + sum(y * math.log2(2 * y / (x + y)) for x, y in zip(p, q) if y) / 2)

    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.2, 0.3, 0.5])
    assert divergence.js_distance(p, q) == pytest.approx(plain(p, q))
    assert divergence.js_distance(p, p) == 0 and divergence.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_distances_and_verdicts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    refs = {r.lang: r for r in divergence.references(docs)}
    rows = docs.collect()
    for lang in {r.lang for r in rows}:
        counter = Counter()
        for r in rows:
            if r.lang == lang:
                counter.update(divergence.plain_word(w) for w in r.text.encode().split())
        top = sorted((w for w in counter if re.search(r"[A-Za-z\x80-\xff]", w.decode("latin-1"))), key=lambda w: (-counter[w], w))[:40]
        assert refs[lang].words == top
        assert refs[lang].word_shares[0] == pytest.approx(counter[top[0]] / sum(counter.values()))
    found = {r.doc_id: r for r in divergence.measures(docs, refs=list(refs.values())).collect()}
    for r in rows[:50]:
        words = [divergence.plain_word(w) for w in r.text.encode().split()]
        best = []
        for lang, ref in sorted(refs.items()):
            counter = Counter(words)
            h = np.array([counter[w] for w in ref.words] + [sum(n for w, n in counter.items() if w not in ref.words)]) / len(words)
            best.append((divergence.js_distance(h, ref.word_shares), lang))
        assert found[r.doc_id].word_distance == pytest.approx(min(best)[0]) and found[r.doc_id].nearest_lang == min(best)[1]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    long = [d for d in labels if not found[d].base_failed]
    good = [found[d].kept for d in long if labels[d] == 1]
    bad = [found[d].kept for d in long if labels[d] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)
    kept = divergence.keep_good(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, r in found.items() if r.kept)


def test_rare_language_beside_a_huge_one(spark):
    """A language of one row in 1,500 is measured against itself; one of too few words for a reference meets the base rule only."""
    rng = np.random.default_rng(4)
    vocabulary = {lang: [f"{lang}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)] for lang in ("big", "rare", "tiny")}
    share = 1 / np.arange(1, 401)
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang], n, p=share / share.sum()))
    rows = [(i, text("big", 60), "big") for i in range(6_000)]
    rows += [(10_000 + i, text("rare", 2_000), "rare") for i in range(4)] + [(20_000, text("tiny", 200), "tiny"), (20_001, "tiny " * 200, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    assert [r.lang for r in divergence.references(docs)] == ["big", "rare"]
    found = {r.doc_id: r for r in divergence.measures(docs.filter("doc_id >= 10000"), refs=divergence.references(docs)).collect()}
    assert all(found[10_000 + i].kept and found[10_000 + i].nearest_lang == "rare" for i in range(4))
    assert found[20_000].kept and not found[20_001].kept
    assert {r.doc_id for r in divergence.keep_good(docs).collect() if r.doc_id >= 10_000} == {10_000, 10_001, 10_002, 10_003, 20_000}
