"""Registration of queries: a name, a DataFrame over the corpus, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmesh.sources.corpus import Corpus, with_views

QUERIES: dict[str, Callable[[Corpus], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the corpus under a name; sql may name the corpus' views."""

    def wrap(f: Callable[[Corpus], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return wrap


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, folder, f=f: f(Corpus(spark, folder)) for name, f in QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items()}
