"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import collections
import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import TESTDATA
from quillmesh.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{TESTDATA}/sf0.001/{t}.parquet'")
    return con


def plain(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.9g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, sf, duck):
    df = catalogue.queries()[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows_of(columns, found.fetchall())
    assert got == want


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["chunk_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
