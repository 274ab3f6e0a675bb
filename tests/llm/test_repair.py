import os
import zlib

import numpy as np
import pytest

from mldiag.llm import repair
from mldiag.llm.common import new_path

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as file:
        return file.read()


@pytest.mark.parametrize("seed", range(12))
def test_round_trip_and_random_access(seed):
    rng = np.random.default_rng(seed)
    kind = seed % 4
    n = int(rng.integers(0, 20_000))
    if kind == 0:
        ids = rng.integers(0, 8, n)
    elif kind == 1:
        ids = np.tile(rng.integers(0, 5000, 37), n // 37 + 1)[:n]
    elif kind == 2:
        ids = np.repeat(rng.integers(0, 4, n // 50 + 1), 50)[:n]
    else:
        ids = np.minimum(rng.zipf(1.3, n), 1 << 31)
    payload = repair.compress(ids.astype(np.uint32))
    block = repair.Block(payload)
    assert (block.ids() == ids).all() and len(block.ids()) == n
    for _ in range(50):
        a, b = sorted(rng.integers(0, n + 2, 2).tolist())
        assert (block.ids(a, b) == ids[a:b]).all()
    if kind == 1 and n > 5000:
        assert len(payload) < n


def test_large_alphabet():
    ids = np.concatenate([np.arange(70_000), np.tile([5, 6, 7, 8], 5000)]).astype(np.uint32)
    block = repair.Block(repair.compress(ids))
    assert (block.ids() == ids).all() and len(block.symbols) < len(ids) - 9_000


def test_damaged_blocks_are_refused():
    payload = bytearray(repair.compress(np.arange(50)))
    payload[-1] ^= 1
    with pytest.raises(ValueError):
        repair.Block(bytes(payload))


TEXTS = ["", None, "Hello WORLD", "a  b\n\tc\x0bd", "<|startoftext|>x <|endoftext|>", "é é́ ́a ΑΣ ΟΔΟΣ. İ", "don't you'll 'S x's 12 3.5!!", " nb sp a b\x1cc\x85d",
         "日本語 テキスト 😀", "ﬁ ½ ²", "word " * 20_000, "x" * 5000, "#$%^&*", "A\rB", "the cat " * 3, "Ａ ｂ", "﻿q"]


@pytest.mark.parametrize("block_ids", [64, repair.BLOCK_IDS])
def test_files_by_whole_texts(spark, vocabulary, block_ids):
    library = tokenizers.Tokenizer.from_str(vocabulary)
    rows = [(3 * i - 9, t, i, "x") for i, t in enumerate(TEXTS)] + [(0, "again a", 1, "y"), (0, "again a", 1, "y"), (None, "no id", 2, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start int, part string").repartition(3)
    path = new_path(spark, "tokens")
    repair.write_tokens(docs, path, vocabulary, block_ids=block_ids)
    wanted = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, *_ in rows]
    got = repair.read_documents(spark, path, ids=True).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted([(r.doc_id, r.ids) for r in got], key=key) == sorted(wanted, key=key)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d or 0))
    stream = []
    for r in ordered:
        assert r.start == len(stream) and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        stream += r.ids
    for a, n in ((0, 5), (len(stream) - 3, 10), (40, 300), (len(stream) // 2, 1)):
        found = sorted(repair.read_range(spark, path, a, n).collect(), key=lambda r: r.position)
        assert found[0].position == a and [x for r in found for x in r.ids] == stream[a : a + n]


def test_empty_table(spark, vocabulary):
    path = new_path(spark, "tokens")
    repair.write_tokens(spark.createDataFrame([], "doc_id bigint, text string"), path, vocabulary)
    assert repair.read_documents(spark, path).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_real_texts(vocabulary):
    import pyarrow.parquet as pq

    library, encoder = tokenizers.Tokenizer.from_str(vocabulary), repair.WordEncoder(vocabulary)
    for text in pq.read_table(f"{FOLDER}/documents.parquet").column("text").to_pylist():
        assert encoder.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids


ODD = [*TEXTS, "end$$$ end&&& end,", "x.'s 'st! don't! a'b a''b 5's (a) [b]c _d e_f", "é. é— a̸=b a≠ n̈! ᾳ; a\x00.b\x1c.c", "<|startoftext|>end$$$", "x<|EndOfText|>.Y.", "a.", ".b", "", "&c"]


@pytest.mark.parametrize("together", [1, 40, 1 << 23])
def test_texts_encoded_together(vocabulary, monkeypatch, together):
    import pyarrow as pa

    monkeypatch.setattr(repair, "TEXT_AT_ONCE", together)
    monkeypatch.setattr(repair, "WORDS_AT_ONCE", max(3, together // 10))
    library, encoder = tokenizers.Tokenizer.from_str(vocabulary), repair.WordEncoder(vocabulary)
    wanted = [library.encode(t or "", add_special_tokens=False).ids for t in ODD]
    column = pa.array(["before", *ODD, "behind"])
    assert [x.tolist() for x in encoder.encode_all(column[1:-1])] == wanted
    assert list(encoder.encode_all(column[:0])) == []
    assert [x.tolist() for x in encoder.encode_all(pa.array([None, "", None], pa.string()))] == [[], [], []]


def test_the_library_gets_each_word_once_for_many_texts(vocabulary):
    """Words are the same whatever mark follows, and many short texts are one call."""
    import pyarrow as pa

    encoder = repair.WordEncoder(vocabulary)
    calls, encode = [], encoder.words.encode
    encoder.words.encode = lambda words: calls.append(words) or encode(words)
    texts = [f"new{'abcdefghij'[i % 10]}ly{mark} other" for i in range(100) for mark in ("", ".", "$$$", "&&&", "*", ")")]
    assert len(list(encoder.encode_all(pa.array(texts)))) == 600
    assert len(calls) == 1 and len(calls[0]) == 10 + 1 + 5


def pair_counts(symbols):
    """How often each neighbouring pair occurs without overlapping itself."""
    counts, last = {}, {}
    for i, pair in enumerate(zip(symbols, symbols[1:])):
        if last.get(pair) != i - 1:
            counts[pair] = counts.get(pair, 0) + 1
            last[pair] = i
    return counts


@pytest.mark.parametrize("seed", range(6))
def test_no_frequent_pair_is_left(seed):
    rng = np.random.default_rng(seed)
    if seed < 4:
        ids = np.minimum(rng.zipf(1.2, 30_000), 3_000) if seed < 2 else rng.integers(0, 3 + 40 * seed, 20_000)
    elif seed == 4:  # all of two bytes taken by the alphabet
        ids = np.append(np.arange(65_536), np.tile([5, 6, 7, 8], 5000))
    else:  # a few frequent pairs among many places that hold none
        ids = np.append(rng.permutation(60_000), np.tile([5, 6, 9, 9, 9], 40))
    block = repair.Block(repair.compress(ids.astype(np.uint32)))
    assert (block.ids() == ids).all()
    assert max(pair_counts(block.symbols.tolist()).values(), default=0) < repair.least_count(len(block.lengths))


def test_a_use_less_would_cost_bytes():
    """A rule of the least count makes the block smaller, one used less does not."""
    for size in (10, 65_536, 65_537, 300_000):
        bits, least = max(16, (size - 1).bit_length()), repair.least_count(size)
        assert least * bits > 2 * bits + 16 >= (least - 1) * bits


@pytest.mark.parametrize("room", [300, 1000, 1 << 16])
def test_a_full_alphabet_grows_only_where_it_pays(room):
    ids = np.minimum(np.random.default_rng(8).zipf(1.2, 30_000), 250).astype(np.uint32)
    payload = repair.compress(ids, room)
    assert (repair.Block(payload).ids() == ids).all()
    assert len(payload) <= 1.02 * len(repair.compress(ids))


def test_more_rules_than_two_bytes_hold():
    pairs = np.arange(80_000).reshape(-1, 2)
    ids = np.concatenate([pairs[np.random.default_rng(i).permutation(len(pairs))].ravel() for i in range(5)])
    block = repair.Block(repair.compress(ids.astype(np.uint32)))
    assert (block.ids() == ids).all() and len(block.symbols) == 200_000 and len(block.lengths) == 120_000


def test_words_that_come_again_are_remembered():
    from mldiag.llm.ragged import Remembered

    asked = []

    def encode(words):
        asked.extend(words)
        return [[len(w)] * (len(w) % 3) for w in words]

    rng = np.random.default_rng(4)
    memory = Remembered(encode, np.uint32, 50)
    for i in range(300):
        words = ["often", "twice"] + ["w" * int(n) for n in rng.integers(1, 200, 5)]
        assert memory.ids(words).tolist() == [len(w) for w in words for _ in range(len(w) % 3)]
        assert len(memory.place) <= 60
    assert asked.count("often") <= 2
