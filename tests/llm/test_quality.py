import zlib

import numpy as np
from pyspark.sql import functions as F

from quillmesh.llm import quality, registry


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    good, bad = (label == 1).sum(), (label == 0).sum()
    return (rank[label == 1].sum() - good * (good + 1) / 2) / (good * bad)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in registry.op4_quality(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [x for x in labels if zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert all(rows[x.doc_id].held_out for x in held)
    assert auc(np.array([rows[x.doc_id].score for x in held]), np.array([x.quality for x in held])) > 0.95
    bad = [rows[x.doc_id].predicted for x in held if x.quality == 0]
    assert np.mean(bad) < 0.3
    good = [rows[x.doc_id].predicted for x in held if x.quality == 1]
    assert np.mean(good) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def test_held_out_labels_are_not_learnt(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda df: sorted((r.doc_id, r.score) for r in df.collect())
    assert key(quality.classify(docs, labels)) == key(quality.classify(docs, flipped))


def test_edge_cases(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (None, "a b", 1.0), (3, "x " * 60_000, 1.0), (3, "x " * 60_000, 1.0), (4, "\x00\n  ", 1.0)], "doc_id long, text string, score double")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 6 and all(r.score is not None for r in rows)
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.accepted(docs, labels.limit(0)).columns == docs.columns


def test_pooling_against_plain_sums():
    rng = np.random.default_rng(1)
    vocabulary = ["the", "The", "###", "7"]
    pool = quality.Pooler(vocabulary, rng.normal(size=(4, quality.DIM)).astype(np.float32))
    for text in ("the The ### 7 the", "one strange the", "the", "", None, "the The 7 ### x! " * 9000):
        v = [pool.vectors[pool.words[t]] for t in __import__("re").findall(r"[^\W\d_]+|\d+|_+|[^\w\s]+", text or "")]
        want = np.zeros(quality.POOLED)
        if v:
            v = np.asarray(v, np.float64)
            want = np.concatenate([v.mean(axis=0), v.std(axis=0), (v[:-1] * v[1:]).sum(axis=0) / len(v)])
        assert np.allclose(pool(text), want, atol=2e-3)  # deviations come from differences of single-precision sums


def test_scores_are_the_network_of_the_pooled_vectors(spark, sf):
    """Every row's score, restated in one process from the fitted parts."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    words, vectors, net = quality.fit(docs, labels)
    pool = quality.Pooler(words, vectors)
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    for r in docs.collect():
        z = (pool(r.text) - net["mean"]) / net["std"]
        logit = np.tanh(z @ net["layers"][0] + net["layers"][1]) @ net["layers"][2] + net["layers"][3][0]
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-logit / net["temperature"]))) < 1e-4


def test_one_id_with_two_texts_and_two_labels(spark):
    docs = spark.createDataFrame([(i, f"good words here {i}" if i % 2 else "## junk ##") for i in range(60)] + [(3, "another text"), (3, "good words here 3")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (3, 1), (5, None)], "doc_id long, quality int")
    rows = [sorted((r.doc_id, r.score) for r in quality.classify(docs, labels).collect()) for _ in range(2)]
    assert rows[0] == rows[1] and len(rows[0]) == 62


def test_text_column_in_any_case(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    other = docs.withColumnRenamed("text", "Text").withColumn("score", F.lit("mine"))
    kept = quality.accepted(other, labels)
    assert kept.columns == other.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.accepted(docs, labels).collect()}


def test_temperature_and_layers():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 6)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    model = quality.train(x, y)
    p = quality.predict(model, x)
    assert auc(p, y) > 0.9 and 0.5 <= model["temperature"] <= 10
    assert quality.train(x, np.ones(800))["constant"] == 1.0


def test_index_vectors_depend_on_the_word_alone():
    assert np.array_equal(quality.index_vector("a", 64), quality.index_vector("a", 64))
    assert np.abs(quality.index_vector("a", 64)).sum() <= quality.NONZERO
