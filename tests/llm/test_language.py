import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from mldiag.llm import language

FOLDER = "/root/testdata/sf0.01"


def plain_model(words, order):
    """Interpolated Kneser-Ney over marked words by dictionaries: p(letter, context before it)."""
    counts = [Counter() for _ in range(order + 1)]
    for word, n in words.items():
        marked = "\x02" + word + "\x02"
        for size in range(1, order + 1):
            for end in range(max(1, size - 1), len(marked)):
                counts[size][(marked[end - size + 1 : end + 1], end == size - 1 and size > 1)] += n
    used = [None] * (order + 1)
    for size in range(1, order + 1):
        used[size] = {}
        for (gram, first), n in counts[size].items():
            if size == order or first:
                used[size][gram] = n
            else:
                used[size][gram] = len({g for g, _ in counts[size + 1] if g[1:] == gram})
    discounts, contexts = [0] * (order + 1), [None] * (order + 1)
    for size in range(1, order + 1):
        values = list(used[size].values())
        ones, twos = values.count(1), values.count(2)
        discounts[size] = ones / (ones + 2 * twos) if ones and twos else 0.5
        contexts[size] = defaultdict(list)
        for gram, n in used[size].items():
            contexts[size][gram[:-1]].append(n)

    def p(gram):
        size = len(gram)
        if size == 0:
            return 1 / (len(used[1]) + 1)
        values = contexts[size].get(gram[:-1])
        if not values:
            return p(gram[1:])
        d, total = discounts[size], sum(values)
        return max(used[size].get(gram, 0) - d, 0) / total + d * len(values) / total * p(gram[1:])

    return p


def test_scores_equal_a_plain_model(spark):
    rng = np.random.default_rng(0)
    words = Counter("".join(rng.choice(list("abcdé"), int(rng.integers(1, 9)), p=[0.4, 0.3, 0.15, 0.1, 0.05])) for _ in range(400))
    table = spark.createDataFrame([("x", w, n) for w, n in words.items()], "lang string, word string, n bigint").repartition(3)
    order = 4
    ngrams = table.mapInArrow(language._count_ngrams(order), "lang string, size int, ngram bigint, context bigint, shorter bigint, first boolean, n bigint")
    rows = ngrams.groupBy("lang", "size", "ngram").agg({"context": "min", "shorter": "min", "first": "max", "n": "sum"}).toDF("lang", "size", "ngram", "x1", "x2", "x3", "x4")
    named = ngrams.groupBy("lang", "size", "ngram").agg(*[f.alias(n) for n, f in _aggregates().items()]).toPandas()
    assert rows.count() == len(named)
    (model,) = language._to_models(language._estimate(order)(named), order)
    p = plain_model(words, order)
    scorer = language.Scorer([model])
    for word in [*list(words)[:60], "zzz", "abz", "a", "dddddddd"]:
        marked = "\x02" + word + "\x02"
        wanted = sum(np.log(p(marked[max(0, i - order + 1) : i + 1])) for i in range(1, len(marked)))
        ((got, letters),) = scorer.entropies([word])
        assert letters == len(word) + 1 and -got[0] * letters == pytest.approx(wanted, rel=1e-9), word


def _aggregates():
    from pyspark.sql import functions as F

    return {"context": F.min("context"), "shorter": F.min("shorter"), "first": F.max("first"), "n": F.sum("n")}


def test_odd_rows(spark):
    en = ["the cat and the dog were here with all of them", "this is what they have been thinking about"] * 20
    de = ["der hund und die katze sind nicht hier gewesen", "das ist was sie über die straße gedacht haben"] * 20
    rows = [(i, t, "en", 1.0) for i, t in enumerate(en)] + [(i + 100, t, "de", 1.0) for i, t in enumerate(de)]
    odd = [None, "", " 12 ½ _ ² 3", "1a", "straße", "x" * 300_000, "the dog " * 80_000, "漢字"]
    rows += [(1000 + i, t, None, 1.0) for i, t in enumerate(odd)] + [(None, "the cat", None, 0.0)] + rows[:2]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double").repartition(3)
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r for r in got}
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    assert [of[1000 + i].lang_pred == "und" for i in range(len(odd))] == [True, True, True] + [False] * 5
    assert of[1004].lang_pred == "de" and of[1006].lang_pred == "en" and of[1006].score > 0.9
    assert all(of[r[0]].lang_pred == r[2] for r in rows[:80])
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).filter("lang is null")).collect()} == {"und"}
    assert language.identify(docs.filter("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    truth = {r.doc_id: (r.lang, len(r.text.split())) for r in docs.collect()}
    rows = language.identify(docs).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 200 < len(held) < 500
    right = [r.lang_pred == truth[r.doc_id][0] for r in held if truth[r.doc_id][1] >= 5]
    assert sum(right) >= 0.99 * len(right)


def test_rare_language_beside_a_hot_one(spark, monkeypatch):
    """40 labelled documents of 50,000 are learned from like any others; too many languages are an error."""
    hot = ["the cat and the dog were here with all of them", "this is what they have been thinking about"]
    rare = ["der hund und die katze sind nicht hier gewesen", "das ist was sie über die straße gedacht haben"]
    rows = [(i, hot[i % 2], "en") for i in range(50_000)] + [(60_000 + i, rare[i % 2], "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    identifier = language.fit(docs)
    assert [m.lang for m in identifier.models] == ["de", "en"]
    found = language.predict(docs.filter("doc_id >= 60000"), identifier).collect()
    assert len(found) == 40 and {r.lang_pred for r in found} == {"de"}
    monkeypatch.setattr(language, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="more than 1 "):
        language.fit(docs)
