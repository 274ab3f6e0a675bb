import os
import random
import zlib

import numpy as np
import pytest

from mldiag.llm import transducer

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = P.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def both():
    return transducer.read_model(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


ODD = ["", " ", "  ", "a", " a", "a ", "  Hello   world\n\n x\t yé漢\U0001f600 ", " " * 40 + "x" + " " * 17, "▁ ▁▁", "<s> </s> <unk> <0x0A>", "\r\n\x00\x07\x85",
       "x" * 3000, "ab" * 900, "日本語のテキスト" * 20, "é́", "https://a.b/c?d=e&f=%20#g" * 5, "\n", "don't WON'T", "﻿bom", "0123456789" * 9, "=" * 100, " nbsp em"]


def test_ids_equal_the_library(both):
    machine, library = both
    encoder = transducer.Encoder(machine)
    rng = random.Random(0)
    texts = list(ODD)
    letters = [t for t in machine.texts if len(t) < 6]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))).replace("▁", " ") for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x500), 32])) for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    for text in texts:
        ids = encoder.encode(text)
        assert ids.tolist() == library.encode(text), repr(text)[:200]
        assert encoder.decode(ids) == text.replace("▁", " ")


def test_documents(spark, both):
    machine, library = both
    texts = ODD + [None, "long text. " * 30_000]
    docs = spark.createDataFrame([(i, t, 1.5, [i]) for i, t in enumerate(texts)] * 2, "doc_id bigint, text string, n_pieces double, other array<int>")
    encoded = transducer.encode(docs, machine)
    assert encoded.columns == ["doc_id", "n_pieces", "other", "n_pieces_", "ids"]
    rows = encoded.collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id] or "") and r.n_pieces_ == len(r.ids) and r.n_pieces == 1.5 and r.other == [r.doc_id]
    for r in transducer.decode(encoded, machine).collect():
        assert r.text == (texts[r.doc_id] or "").replace("▁", " ")
    for r in transducer.digest(docs, machine).collect():
        ids = library.encode(texts[r.doc_id] or "")
        assert r.round_trip and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.n_byte_pieces == sum(map(library.is_byte, ids))
    assert transducer.digest(docs.filter("false"), machine).count() == 0 and transducer.encode(docs.filter("false"), machine).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_real_texts_equal_the_library(spark, both):
    machine, library = both
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    wanted = {r.doc_id: zlib.crc32(np.array(library.encode(r.text), "<u4").tobytes()) for r in docs.collect()}
    assert {r.doc_id: r.ids_crc32 for r in transducer.digest(docs, machine).collect()} == wanted
