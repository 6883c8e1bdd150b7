import zlib

import numpy as np
from pyspark.sql import functions as F

from quillmesh.llm import langid, registry


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.op5_language(spark, sf).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) > 0.97


def test_held_out_rows_are_not_learnt(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    key = lambda df: sorted((r.doc_id, r.lang_pred, r.score) for r in df.collect())
    assert key(langid.identify(docs)) == key(langid.identify(docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))))


def test_predictions_restated_from_kernels(spark, sf):
    """Every row's language from the kernel with each landmark, by sets of cells, and the weights."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    marks = [set(np.flatnonzero(row).tolist()) for row in model.landmarks]
    got = {r.doc_id: r for r in langid.identify(docs, model=model).collect()}
    for r in docs.collect():
        if langid.has_letter(r.text):
            own = set(np.flatnonzero(langid.presence(r.text)).tolist())
            kernel = np.array([len(own & m) / np.sqrt(len(own) * len(m)) for m in marks])
            margin = kernel @ model.weights + model.bias
            p = np.exp(model.steep * (margin - margin.max()))
            assert got[r.doc_id].lang_pred == model.languages[int(margin.argmax())] and abs(got[r.doc_id].score - p.max() / p.sum()) < 1e-3
        else:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)


def test_long_texts_and_repeated_ids_are_learnt(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "el gato y la casa ") * 3, "en" if i % 2 else "es") for i in range(40)] + [(41, "the house of the cat " * 30_000, "en"), (41, "the", "en"), (3, "otro texto", "es"), (3, "the cat", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    first, again = ([tuple(r) for r in langid.identify(df).orderBy("doc_id", "score").collect()] for df in (docs, docs.orderBy(F.desc("doc_id"), "text")))
    assert first == again and all(r[2] == ("en" if r[0] % 2 else "es") for r in first if r[0] != 3)


def test_presence_is_the_set_of_hashed_ngrams():
    text = "Añb, 12 c"
    raw = b" " + bytes(32 if c < 128 and not chr(c).isalpha() else c for c in text.lower().encode()) + b" "
    want = np.zeros(langid.CELLS, bool)
    for n in (1, 2, 3, 4):
        for i in range(len(raw) - n + 1):
            code = 0
            for c in raw[i : i + n]:
                code = (code * 257 + c + 1) % 2**32
            want[(code * int(langid._MULTIPLIERS[n - 1]) % 2**32) >> 19] = True
    assert np.array_equal(langid.presence(text), want)


def test_kernel_is_the_normalised_overlap():
    a, b = langid.presence("the cat"), langid.presence("the dog sat")
    x = langid.matrix([a, b])
    assert np.isclose(x[0] @ x[1], (a & b).sum() / np.sqrt(a.sum() * b.sum()))


def test_presence_of_long_texts_is_whole():
    text = "ab" * 600_000 + "zq"
    assert langid.presence(text)[np.flatnonzero(langid.presence("zq"))[1:]].sum() > 0
    pieces = langid.presence("b" * 3 + "zq")
    assert (langid.presence(text) & pieces).sum() >= langid.presence("bzq").sum() - 4


def test_edge_cases(spark):
    rows = [(i, "le chat est la et les chiens" if i % 2 else "the cat is there and the dogs", "fr" if i % 2 else "en") for i in range(80)]
    docs = spark.createDataFrame([*rows, (100, None, "en"), (101, "", "fr"), (102, "123 !?", None), (103, "the the cats", None), (None, "les chats", "fr"), (104, "é", None), (104, "é", None), (105, "the " * 90_000, None)], "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    out = langid.identify(docs).collect()
    assert len(out) == 88
    found = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert found[100] == found[101] == found[102] == ("und", 0.0)
    assert found[103][0] == found[105][0] == "en" and found[None][0] == "fr" and found[104][0] in ("en", "fr")
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.lang_pred for r in langid.identify(docs.filter("lang = 'en' and text is not null")).collect()} == {"en"}
