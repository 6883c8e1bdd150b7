import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillmesh.llm import mixing, registry


def fill(sizes):
    """Targets by the contract's loop: share by weight, cap at three times, reshare the excess."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if 3 * sizes[s] <= share * weight[s]}
        if not over:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, "d": 70, None: 3}, {"a": 5}, {"a": 0, "b": 0}, {"a": 1, "b": 1, "c": 1}, {f"s{i:02}": (i * 7919) % 101 for i in range(40)}])
def test_targets_equal_the_loop(spark, sizes):
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = fill(sizes)
    assert {r.source: pytest.approx(r.target) for r in rows} == want


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    rows = registry.op9_source_mixing(spark, sf).collect()
    assert len(rows) == len(texts)
    taken, target = {}, {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id].text or ""))
        assert r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"])
        source = texts[r.doc_id].source
        taken[source] = taken.get(source, 0) + r.taken
        target[source] = r.target
    largest = max(r["size"] for r in rows)
    assert all(abs(taken[s] - target[s]) <= largest for s in target)
    assert sorted(rows) == sorted(registry.op9_source_mixing(spark, sf).collect())


def test_edge_cases_and_emission(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 9), (2, None, None, 9), (None, "c", None, 9), (3, "", "y", 9), (3, "", "y", 9), (4, "  q", "z", 9)], "doc_id long, text string, source string, size int")
    mixed = mixing.mix(docs)
    rows = mixed.collect()
    assert len(rows) == 6
    assert {(r.doc_id, r["size"]) for r in rows} == {(1, 2), (2, 0), (None, 1), (3, 0), (4, 2)}
    assert mixing.emit(docs).count() == mixed.agg(F.sum("copies")).first()[0]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_draw_is_the_digest(spark):
    row = spark.range(5).select("id", mixing.draw(F.col("id")).alias("d")).collect()
    assert all(r.d == int(hashlib.md5(str(r.id).encode()).hexdigest()[:3], 16) for r in row)


def test_clashing_columns_come_back_untouched(spark):
    names = ["copy", "below", "size", "target", "source_size", "mix_source", "copies", "row", "mix", "per", "by", "draw", "a.b"]
    docs = spark.createDataFrame([(i, "w " * i, "xyz"[i % 3], *[f"{n}{i}" for n in names]) for i in range(30)], ["doc_id", "Text", "source", *names])
    times = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    want = sorted(tuple(r) for r in docs.collect() for _ in range(times[r.doc_id]))
    assert sorted(map(tuple, out.collect())) == want and want
    assert mixing.mix(docs).columns == ["doc_id", "size", "source_size", "target", "copies"]


def test_ties_and_a_source_of_one_long_text(spark):
    docs = spark.createDataFrame([(i, "a b", "s") for i in range(8)] + [(9, "w " * 300_000, "long"), (10, "w", None)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    assert sorted(rows) == sorted(mixing.mix(docs).collect())
    assert all(r.copies <= 3 for r in rows) and {r["size"] for r in rows} == {1, 2, 300_000}
