import random
import re

import numpy as np
import pytest

from quillmesh.llm import neardup, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()


def brute(texts, percent=80):
    """doc_id -> (set size, component), by comparing every two distinct sets."""
    sets = {i: plain_set(t) for i, t in texts.items()}
    own = {i: i for i in texts}

    def top(i):
        while own[i] != i:
            i = own[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = top(a), top(b)
                    own[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in texts}


def check(texts, rows):
    want = brute(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check({r.doc_id: r.text for r in docs.collect()}, registry.op2_minhash_neardup(spark, sf).collect())


def test_group_of_copies_around_the_threshold(spark):
    """Copies with many edits: some link only through others, some stay alone, all share buckets."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    texts = {}
    for i in range(160):
        words = list(base)
        for _ in range(rng.choice([1, 3, 6, 8, 10, 12])):
            words[rng.randrange(120)] = f"e{rng.randrange(60)}"
        texts[i * 3] = " ".join(words)
    check(texts, neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect())


@pytest.mark.parametrize("block, room", [(600, 900), (50_000, 300), (400, 400_000)])
def test_groups_of_unequal_sizes_in_many_blocks_and_rooms(spark, monkeypatch, block, room):
    """Copies cut to many lengths, so that sets of the same bucket lie in several size classes, blocks and rooms."""
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(neardup, "ROOM_SHINGLES", room)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(240)]
    texts = {}
    for i in range(150):
        words = base[: rng.randrange(60, 240)]
        for _ in range(rng.randrange(0, 14)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(40)}"
        texts[i] = " ".join(words)
    check(texts, neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect())


def test_chain_of_links(spark):
    words = [f"c{i}" for i in range(400)]
    texts = {i: " ".join(words[i * 8 : i * 8 + 120]) for i in range(30)}
    rows = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    check(texts, rows)
    assert {r.component_id for r in rows} == {0}


def test_edge_cases(spark):
    texts = {1: None, 2: "", 3: " \t", 4: "one", 5: "ONE", 6: "É", 7: "é", 8: "a b", 9: "A\nB", 10: "b a", 11: "x " * 30_000 + "y", 12: "x y x"}
    docs = spark.createDataFrame([(k, v, 0) for k, v in texts.items()], "doc_id long, text string, component_id int")
    check(texts, neardup.near_duplicates(docs).collect())
    extra = spark.createDataFrame([(None, "a b", 0), (8, "a b", 0)], docs.schema)
    rows = neardup.near_duplicates(docs.union(extra)).collect()
    assert len(rows) == 14
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8, 0.95])
def test_estimate_is_corrected_for_chance(spark, share):
    n = 4000
    a = np.arange(n).astype(np.uint64)
    b = np.concatenate([a[: int(n * share)], np.arange(10**6, 10**6 + n - int(n * share)).astype(np.uint64)])
    mix = lambda x: (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ ((x + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(17))
    sa, sb = (neardup.signature(neardup.minima(np.unique(mix(x))))[1] for x in (a, b))
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(sa, sb)], "a array<long>, b array<long>").select(neardup.estimate(F.col("a"), F.col("b")).alias("e")).first().e
    true = share / (2 - share)
    assert abs(got - true) < 0.16
