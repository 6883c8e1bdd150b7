import pytest
from pyspark.sql import functions as F

from quillmesh.operators import embedding, hooks
from quillmesh.sources.store import Store, keep_ir, kept_ir


def test_models_see_what_is_unsure(spark):
    rows = spark.createDataFrame([(str(i), f"text {i}", i / 10, [("a", i / 10)]) for i in range(8)], "id string, text string, c double, labels array<struct<label: string, confidence: double>>")
    some = hooks.unsure(rows, F.col("c"), 0.55, 3, "id")
    assert [r.id for r in some.orderBy("id").collect()] == ["0", "1", "2"]

    def model(texts):
        return [[("b", 0.4), ("odd", 1.0), ("a", 7.0)] if not t.endswith("2") else [] for t in texts]

    answers = hooks.labelled(some, "id", "text", model, ("a", "b"))
    got = {r.id: [tuple(x) for x in r.labels] for r in hooks.refined(rows, "id", answers, "labels").collect()}
    assert got["0"] == [("a", 1.0), ("b", 0.4)] and got["2"] == [("a", 0.2)] and got["7"] == [("a", 0.7)]
    ordered = hooks.labelled(some, "id", "text", model, ("a", "b"), keep_order=True).filter("id = '0'").first().labels
    assert [x.label for x in ordered] == ["b", "a"]


def test_reranking(spark):
    items = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "cccc")], "id long, text string")
    got = hooks.reranked(items, "q", "text", lambda q, texts: [float(len(t)) for t in texts], 2)
    assert [r.id for r in got.orderBy(F.col("model_score").desc()).collect()] == [3, 1]


def test_vectors_as_bytes():
    assert embedding.unpack(embedding.pack([1.0, -0.5])) == [1.0, -0.5]


def test_embedding_is_unit_and_stable(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "a b a")], "id long, text string")
    v = {r.id: r.embedding for r in embedding.embed(df, "id", 16).collect()}
    assert v[1] == v[3] and abs(sum(x * x for x in v[1]) - 1) < 1e-5 and not any(v[2])


def test_a_corpus_moves_only_onto_its_own(spark, tmp_path):
    meta = lambda target: spark.createDataFrame([("target_paper_id", target)], "key string, value string")
    one, two = Store(spark, f"{tmp_path}/1"), Store(spark, f"{tmp_path}/2")
    one.write("meta", meta("x"))
    assert one.copy_to(f"{tmp_path}/3").meta("target_paper_id") == "x"
    one.copy_to(f"{tmp_path}/3")
    two.write("meta", meta("y"))
    with pytest.raises(ValueError):
        one.copy_to(f"{tmp_path}/2")
    assert two.read("papers").count() == 0


def test_parsed_documents_by_version(spark, tmp_path):
    df = spark.createDataFrame([("p", 1)], "paper_id string, n int")
    for version, n in (("4", 1), ("5", 2), ("5", 3)):
        keep_ir(df.withColumn("n", F.lit(n)), f"{tmp_path}/ir", version)
    assert [r.n for r in kept_ir(spark, f"{tmp_path}/ir", "5").collect()] == [3]
    assert [r.n for r in kept_ir(spark, f"{tmp_path}/ir", "4").collect()] == [1]
