"""The pipeline against a plain version that shares only the pure functions of single texts."""

import os
import re

import pytest

import corpus_pipeline
from mldiag.llm import divergence, mixing
from tests.llm.test_near_copies import plain_kept

sentencepiece = pytest.importorskip("sentencepiece")
FOLDER = "/root/testdata/sf0.001"


def plain_near(rows):
    return plain_kept([(r.doc_id, r.text) for r in rows])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_stages_and_run(spark):
    import public_tokenizers

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.collect()
    kept = {}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER)
        assert after.columns == docs.columns
        after = spark.createDataFrame(after.collect(), docs.schema)
        kept[name] = after.collect()
        before = after
    good = {r.doc_id for r in divergence.measures(docs).collect() if r.kept}
    assert sorted(r.doc_id for r in kept["quality"]) == sorted(good)
    owner = {}
    for r in rows:
        if r.doc_id in good:
            owner[r.text] = max(owner.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in kept["exact"]) == sorted(owner.values())
    near = plain_near(kept["exact"])
    assert sorted(r.doc_id for r in kept["near"]) == sorted(near)
    taken = {r.doc_id: r.taken // max(1, r.size) for r in mixing.mix_table(spark.createDataFrame(kept["near"], docs.schema)).collect()}
    times = {}
    for r in kept["mix"]:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {d: n for d, n in taken.items() if n}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = sum(words(r.text) for r in kept["near"])
    assert sum(words(r.text) for r in kept["mix"]) == pytest.approx(1.5 * total, rel=0.005)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    wanted = sorted((r.doc_id, r.lang, r.source, library.encode(r.text)) for r in kept["mix"])
    result = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.lang, r.source, r.ids) for r in result) == wanted
    assert all(r.n_pieces == len(r.ids) for r in result)


def test_odd_documents(spark):
    good = "the cat and the dog were here with all of them, and this is what they have seen by the river. "
    text = lambda i: " ".join(f"{good}number {i * 10 + k} of the {i}th walk." for k in range(6))
    rows = [(i, text(i), "en", f"s{i % 3}", 5, i) for i in range(40)] + [(None, text(99), None, None, None, 1), (50, None, "en", "s1", 0, 1), (51, "", "en", None, 0, 1)]
    rows += rows[:4]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int"
    docs = spark.createDataFrame(rows, schema)
    for some in (docs, docs.filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, some, "")
            if name != "encode":
                assert after.columns == docs.columns
            some = spark.createDataFrame(after.collect(), after.schema)
    assert some.count() == 0
