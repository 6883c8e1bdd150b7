"""The pipeline's rows against plain Python, stage by stage."""

import types
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_neardup import brute
from test_packing import verify

from quillmesh.llm import common, mixing, quality, secrets


def test_stages_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    every = {r.doc_id: r for r in docs.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5

    def stage(k, df, path):
        corpus_pipeline.STAGES[k][1](spark, df, sf).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        # 1: the classifier's own scores decide.
        one = stage(0, docs, f"{folder}/1")
        scored = quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
        assert one.columns == docs.columns
        kept = {r.doc_id: every[r.doc_id] for r in scored if r.score >= 0.3}
        assert {r.doc_id: r for r in one.collect()} == kept
        # 2: the smallest id of each component of brute-force links.
        two = stage(1, one, f"{folder}/2")
        found = brute({i: r.text for i, r in kept.items()})
        left = {i: r for i, r in kept.items() if found[i][1] == i}
        assert two.columns == docs.columns and {r.doc_id: r for r in two.collect()} == left
        # 3: the same field's redaction, text by text.
        three = stage(2, two, f"{folder}/3")
        field = secrets.fit(two)
        want = {i: (r.lang, r.source, secrets.redacted(r.text, field)) for i, r in left.items()}
        assert all(secrets.base_spans(t) == [] for _, _, t in want.values())
        got = three.collect()
        assert three.columns == docs.columns
        assert {r.doc_id: (r.lang, r.source, r.text) for r in got} == want
        assert all(r.n_chars == len(r.text) for r in got)
        assert all("[SECRET]" in w[2] or w[2] == left[i].text for i, w in want.items())
        # 4: each document as often as the mix says.
        four = stage(3, three, f"{folder}/4")
        times = {r.doc_id: r.copies for r in mixing.mix(three).collect()}
        assert four.columns == docs.columns
        assert Counter(r.doc_id for r in four.collect()) == Counter({i: n for i, n in times.items() if n})
        # 5: every copy packed whole.
        five = stage(4, four, f"{folder}/5")
        rows = five.collect()
        starts = Counter((r.doc_id, r.start) for r in rows)
        assert all(starts[i, 0] == n for i, n in times.items() if n)
        single = {i: want[i][2] for i, n in times.items() if n == 1}
        bins = {}
        for r in rows:
            bins.setdefault(r.sequence_id, []).append(r)
        for inside in bins.values():
            at = 0
            for r in sorted(inside, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 4096
        alone = [r for r in rows if r.doc_id in single]
        renumbered, at = [], Counter()
        for r in sorted(alone, key=lambda r: (r.sequence_id, r.offset)):
            renumbered.append(type("R", (), {**r.asDict(), "offset": at[r.sequence_id]}))
            at[r.sequence_id] += r.length
        verify(single, renumbered)


def test_run_is_the_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(rows.columns)
    assert rows.count() > 0


def test_empty_and_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "a b c", "en", None, 5), (9003, "a b c", "en", None, 5)], docs.schema)
    for df in (docs.limit(0), odd):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            df = stage(spark, df, sf)
            df = spark.createDataFrame(df.collect(), df.schema) if k < 4 else df
        df.collect()


def test_clashing_columns_come_through_untouched(spark, sf):
    """Columns named like those of the operators, and text in another case: values stay with their rows through four stages."""
    names = ["copy", "below", "size", "target", "source_size", "mix_source", "copies", "component_id", "kept", "dropped", "score", "spans", "row", "id", "a.b"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("text", "Text").withColumnRenamed("n_chars", "N_Chars")
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.cut(stage(spark, docs, sf))
        if k < 4:
            assert out.columns == docs.columns
            assert out.filter(" or ".join(f"`{n}` <> concat('{n}', doc_id)" for n in names)).isEmpty() and not out.isEmpty()
        docs = out


def test_written_tables_go(spark, sf):
    """After a run only its result is left in the shared folder; without a shared folder on a cluster nothing is written."""
    folder = common.shared_dir(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = lambda: {f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}
    before = there()
    rows = corpus_pipeline.run(spark, sf)
    assert len(there() - before) == 1 and rows.count() > 0


def test_no_shared_folder_on_a_cluster():
    class Nothing:
        def __getattr__(self, name):
            return lambda *a: Nothing()

        def isDefined(self):
            return False

    session = types.SimpleNamespace(sparkContext=types.SimpleNamespace(_jsc=Nothing(), master="spark://host:7077"), conf=types.SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(session)
