"""Incremental ingest: micro-batches upserted by key, and append-only logs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows with equal keys, the one of the greatest order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last()))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def merged(table: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """table with changes put in: rows of equal keys are replaced, new ones added."""
    fresh = latest(changes, keys, order)
    return table.join(fresh, list(keys), "left_anti").unionByName(fresh)


def upsert(path: str, keys: Sequence[str], order: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a versioned table of Parquet folders, path/v=N. A batch that is retried writes its version anew."""

    def apply(batch: DataFrame, number: int) -> None:
        fresh = latest(batch, keys, order)
        before = read(batch.sparkSession, path, number)
        out = fresh if before is None else merged(before, batch, keys, order)
        out.write.mode("overwrite").parquet(f"{path}/v={number + 1}")

    return apply


def versions(spark: SparkSession, path: str) -> list[int]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(hadoop):
        return []
    names = [s.getPath() for s in fs.listStatus(hadoop)]
    done = [p.getName() for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.removeprefix("v=")) for n in done if n.startswith("v="))


def read(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame | None:
    """The newest whole version (not above upto); None where there is none."""
    found = [v for v in versions(spark, path) if upto is None or v <= upto]
    return spark.read.parquet(f"{path}/v={found[-1]}") if found else None


def run(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: str) -> StreamingQuery:
    """Take what is there and stop (AvailableNow)."""
    return stream.writeStream.foreachBatch(upsert(path, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An append-only log as Parquet, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
