"""All registered queries of the document-graph operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmesh.plans import aggregates, base, classification, extraction, filters, graphs, memory, parsing, retrieval, scalars, streams, windows  # noqa: F401  each registers its queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.registered()["ret_query_hybrid"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return base.registered()


def oracle_sql() -> dict[str, str]:
    return base.oracles()
