"""From documents to packed training sequences: five stages, each the whole table of the one before.

Every stage is a function of (spark, docs, sf_dir). Its result is written as Parquet and read again
before the next stage; what a stage wrote on its way is deleted then. All but the last return the
columns of documents.

Edge cases, in every stage. Null doc_id: kept in all stages (nothing links to it, it is packed with a
null id). Null or empty text: scored by the classifier like others, linked with nothing, without
secrets, of size 0 (so the mix takes it as often as its source's rate says), packed as an end id
alone. Very long texts: whole. Ties: as each operator's module says. Repeated rows: each judged alike
and kept or dropped alike, for a group of near-duplicates keeps the rows of its smallest id. Empty
table: no rows. Columns other than doc_id, text, source and n_chars: neither read nor changed by the
first four stages, whatever their names (text may be spelt in any case); the last has columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import mixing, neardup, packing, quality, registry, secrets
from quillmesh.llm.common import free_name, scratch, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    dropped, name = neardup.near_duplicates(docs).filter(~F.col("kept")), free_name(docs, "dropped")
    return docs.join(dropped.select(F.col("doc_id").alias(name)).distinct(), F.col("doc_id") == F.col(name), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with what the scan finds replaced."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.emit(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 tokens."""
    return packing.pack(docs, registry.vocabulary())


STAGES = [
    ("quality classifier", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("secret scan", redact_secrets),
    ("source mixing", mix_sources),
    ("packing", pack_windows),
]

#: SQL can't express a trained network, a random field or a tokenizer; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as keep_last:
        for _, stage in STAGES:
            with scratch(spark) as keep:
                docs = keep(stage(spark, docs, sf_dir))
        return keep_last(docs)
