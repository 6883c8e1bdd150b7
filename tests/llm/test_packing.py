import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillmesh.llm import packing, registry

TOK = Tokenizer.from_file(registry.vocabulary())


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids + [2]


def verify(texts, rows, window=4096):
    """texts: doc_id -> text (unique ids)."""
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc_id, text in texts.items():
        ids, at = ids_of(text), 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            part = np.asarray(ids[at : at + r.length], "<u4").tobytes()
            assert zlib.crc32(part) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    waste = 0
    for rows_in in bins.values():
        at = 0
        for r in sorted(rows_in, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        waste += 0 if at & (at - 1) == 0 else window - at
    return waste / sum(r.length for r in rows)


def test_whole_table_against_plain_tokenizing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    waste = verify(texts, registry.op1_packing(spark, sf).collect())
    assert waste < 0.1


def test_edge_cases(spark):
    texts = {1: None, 2: "", 3: "don't stop <|endoftext|>x a\x1cb\u0085c" * 3, 4: "word " * 20_000, 5: "x" * 50_000, 6: "ÉTÉ d'été ΣΑΣ ﬁ"}
    docs = spark.createDataFrame([(k, v, 7) for k, v in texts.items()], "doc_id long, text string, length int")
    verify(texts, packing.pack(docs, registry.vocabulary()).collect())


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 3 + [(None, "z")], "doc_id long, text string")
    rows = packing.pack(docs, registry.vocabulary()).collect()
    assert len(rows) == 4
    assert packing.pack(docs.limit(0), registry.vocabulary()).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_difference_keeps_every_item(k):
    rng = np.random.default_rng(k)
    lengths = rng.integers(1, 4000, 60).tolist()
    window, sums = packing.difference(lengths, k)
    assert np.array_equal(np.bincount(window, lengths, k).astype(int)[np.argsort(-np.bincount(window, lengths, k), kind="stable")], np.sort(sums)[::-1])
    assert sums.max() - sums.min() <= max(lengths)


def test_differencing_beats_the_textbook_greedy_example():
    window, sums = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sums) == [14, 16]


def test_capacity_raises_the_window_count():
    found = packing.pack_block([3000, 3000, 3000, 900, 900], 4096)
    assert np.bincount(found, [3000, 3000, 3000, 900, 900]).max() <= 4096


def test_a_mass_of_repeated_rows_is_spread(spark):
    docs = spark.range(40_000).selectExpr("1L as doc_id", "'a b c d e f g h i j k l m n o p q r s t u v w x y z' as text")
    one = len(ids_of("a b c d e f g h i j k l m n o p q r s t u v w x y z"))
    packed = packing.pack(docs, registry.vocabulary())
    assert packed.rdd.getNumPartitions() > 3
    bins = defaultdict(int)
    for r in packed.collect():
        bins[r.sequence_id] += r.length
    assert sum(bins.values()) == one * 40_000 and max(bins.values()) <= 4096
    # Short texts: blocks of 64 windows leave at most one of them, and what no further text fits into, empty.
    assert len(bins) <= 1.04 * one * 40_000 / 4096 + 1


def test_many_windows_by_the_same_steps():
    lengths = [2100] * 300
    found = packing.pack_block(lengths, 4096)
    assert np.bincount(found, lengths).max() <= 4096


def test_each_different_word_is_looked_up_once():
    class Counting(packing._Known):
        asked = 0

        def __getitem__(self, chunk):
            Counting.asked += 1
            return super().__getitem__(chunk)

    encoder = packing.ChunkEncoder(registry.vocabulary())
    encoder.known = Counting()
    texts = ["One two. three, " * 5_000, None, "one TWO." * 3]
    assert encoder.encode(pa.array(texts)) == [np.asarray(ids_of(t)[:-1], "<u4").tobytes() for t in texts]
    assert Counting.asked <= 10


def test_ids_of_odd_texts_are_the_tokenizers():
    rng = np.random.default_rng(5)
    marks = list("aB1.,;'\n\t \x0b\x0c\x1cé<|>  Σ\x00\u0085") + ["<|endoftext|>", "z. ", "9, "]
    texts = ["".join(rng.choice(marks, rng.integers(0, 60))) for _ in range(2_000)]
    found = packing.ChunkEncoder(registry.vocabulary()).encode(pa.array(["cut", *texts]).slice(1))
    assert found == [np.asarray(ids_of(t)[:-1], "<u4").tobytes() for t in texts]
