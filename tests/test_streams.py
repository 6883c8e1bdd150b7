import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillmesh.streaming import events, ingest


def drained(df, name, mode="complete"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("events"))
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.mode("overwrite").parquet(out)
    return out


@pytest.mark.parametrize("window", [events.tumbling, events.sliding])
def test_a_stream_and_a_batch_agree(spark, folder, window):
    stream = drained(window(events.source(spark, folder)), window.__name__)
    batch = window(spark.read.schema(events.SCHEMA).parquet(folder))
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_sessions_close_by_gap(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, 7, "x", 1.0, "{}"), (2, t + dt.timedelta(minutes=20), 7, "x", 1.0, "{}"), (3, t + dt.timedelta(hours=2), 7, "x", 1.0, "{}"), (4, t + dt.timedelta(days=2), 8, "x", 1.0, "{}")]
    spark.createDataFrame(rows, events.SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/e")
    got = drained(events.sessions(events.source(spark, f"{tmp_path}/e")), "sessions", "append").filter("user_id = 7").orderBy("start").collect()
    assert [r.n for r in got] == [2, 1]


def test_late_rows_and_repeats(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, 7, "x", 1.0, "{}"), (1, t, 7, "x", 1.0, "{}"), (2, t, 8, "x", 1.0, "{}")]
    spark.createDataFrame(rows, events.SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/e")
    assert drained(events.unique(events.source(spark, f"{tmp_path}/e")), "unique_events", "append").count() == 2


def test_upsert_and_append(spark, tmp_path):
    source, table, log = f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/log"
    schema = "uid string, n long, name string"
    spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], schema).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    ingest.run(stream(), table, f"{tmp_path}/c1", ["uid"], "n").awaitTermination(120)
    spark.createDataFrame([("b", 2, "new"), ("c", 1, "new"), ("c", 3, "newest")], schema).write.mode("append").parquet(source)
    ingest.run(stream(), table, f"{tmp_path}/c1", ["uid"], "n").awaitTermination(120)
    assert {r.uid: r.name for r in ingest.read(spark, table).collect()} == {"a": "old", "b": "new", "c": "newest"}
    assert len(ingest.versions(spark, table)) == 2
    for _ in range(2):
        ingest.append(stream(), log, f"{tmp_path}/c2").awaitTermination(120)
    assert spark.read.parquet(log).count() == 5
    assert ingest.read(spark, f"{tmp_path}/none") is None


def test_latest(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", None)], "k string, n int")
    assert sorted(map(tuple, ingest.latest(df, ["k"], "n").collect())) == [("a", 3), ("b", None)]
    assert ingest.latest(df.filter(F.lit(False)), ["k"], "n").count() == 0
