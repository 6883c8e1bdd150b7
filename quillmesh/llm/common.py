"""What the training-data operators share: table access and lineage cuts in the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session that runs in this one process (local, as in tests) gets a folder of
    its own, which goes when the process ends. On a cluster that is an error: executors would write
    to their own disks, and readers would find nothing or a part.
    """
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="quillmesh-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


#: Folders written by cut and not yet given back, innermost scope last.
_scopes: list[list[str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    The lineage above is done once, a lost executor costs no recomputation, and the
    reader knows the table's true size, on which joins are chosen. The table goes when the
    application ends, or before, by ``release`` or at the end of a ``scratch``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_into = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame | None) -> None:
    """Delete tables written by cut that nothing reads any more (of a round before, in loops)."""
    for t in tables:
        if path := getattr(t, "_cut_into", None):
            _remove(t.sparkSession, path)
            t._cut_into = None


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope whose tables written by cut go at its end, but for those given to what it yields (which writes them if need be)."""
    mine: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        out = df if getattr(df, "_cut_into", None) else cut(df)
        kept.append(out._cut_into)
        return out

    _scopes.append(mine)
    try:
        yield keep
    finally:
        _scopes.remove(mine)
        for path in mine:
            if path not in kept:
                _remove(spark, path)
        if _scopes:
            _scopes[-1].extend(kept)


def place(df: DataFrame, name: str) -> int:
    """Where a column stands, its name compared in any case."""
    return [c.lower() for c in df.columns].index(name)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or with underscores before it, such that df has no column of it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, run: Callable, schema: Any, most: int = 16 << 20) -> DataFrame:
    """df.mapInArrow in batches of at most so many bytes.

    A batch is held several times over (by the JVM, the worker's Arrow and its Python objects), in
    every task of an executor at once; long texts make the default of 64 MB too much.
    """
    spark = df.sparkSession
    bound = (spark.conf.get(BATCH_BYTES, None) or "").rstrip("b")
    if not bound.isdigit() or int(bound) > most:
        spark.conf.set(BATCH_BYTES, str(most))
    if isinstance(schema, StructType) and any("." in c or "`" in c for c in df.columns):
        # mapInArrow takes such names for paths; the rows go through under numbers.
        numbered = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema)])
        return df.toDF(*numbered.names).mapInArrow(run, numbered).toDF(*schema.names)
    return df.mapInArrow(run, schema)


def _trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


_held: list[Any] = [None, None]


def remembered(owner: str, make: Callable[[], Any]) -> Any:
    """What an operator keeps in a Python worker from task to task.

    Workers outlive stages; so one operator's memory goes when another one asks for its own.
    """
    if _held[0] != owner:
        _held[:] = [owner, None]
        gc.collect()
        pa.default_memory_pool().release_unused()
        _trim()
        _held[1] = make()
    return _held[1]
