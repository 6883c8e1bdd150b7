"""A Spark data source for SQLite files: spark.read.format("sqlite").option("path", ...).option("table", ...)."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

#: What a declared type's name decides, first match wins.
AFFINITY = (("INT", LongType()), ("CHAR", StringType()), ("CLOB", StringType()), ("TEXT", StringType()), ("BLOB", BinaryType()), ("REAL", DoubleType()), ("FLOA", DoubleType()), ("DOUB", DoubleType()))


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Rows(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    """Ranges of row ids, one a partition, each read through its own read-only connection."""

    def __init__(self, path: str, table: str, schema: StructType, partitions: int):
        self.path, self.table, self.fields, self.count = path, table, schema, partitions

    def partitions(self) -> list[Rows]:
        with _open(self.path) as con:
            low, high = con.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
        if low is None:
            return [Rows(1, 0)]
        step = -(-(high - low + 1) // self.count)
        return [Rows(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        kinds = {LongType: int, DoubleType: float, StringType: str, BinaryType: bytes}
        make = [kinds[type(f.dataType)] for f in self.fields]
        columns = ", ".join(_quoted(f.name) for f in self.fields)
        with _open(self.path) as con:
            for row in con.execute(f"select {columns} from {_quoted(self.table)} where rowid between ? and ?", (partition.low, partition.high)):
                yield tuple(None if v is None else v if isinstance(v, m) else m(v) for v, m in zip(row, make, strict=True))


class SqliteSource(DataSource):
    """Options: path, table, partitions (default 4). The file must be where executors can read it."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with _open(self.options["path"]) as con:
            declared = con.execute(f"pragma table_info({_quoted(self.options['table'])})").fetchall()
        if not declared:
            raise ValueError(f"no table {self.options['table']}")
        return StructType([StructField(name, next((t for mark, t in AFFINITY if mark in kind.upper()), StringType())) for _, name, kind, *_ in declared])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], schema, int(self.options.get("partitions", "4")))
