"""Materialised outputs: tables, JSON, and text written from the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.ranking import top_per_group


def write_tables(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """Each table as Parquet below the folder."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")


def write_partition(df: DataFrame, folder: str, column: str) -> None:
    """Overwrite only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(folder)


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def write_text(df: DataFrame, column: str, folder: str, mode: str = "append") -> None:
    """One line or page per row; append keeps a log."""
    df.select(F.col(column).alias("value")).write.mode(mode).text(folder)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of JSON: the tables' numbers of rows."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).withColumn("of", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    return counts.groupBy().pivot("of", list(tables)).agg(F.first("n")).select(F.to_json(F.struct(*tables)).alias("manifest"))


def brief(atoms: DataFrame, most: int) -> DataFrame:
    """category, block: a list of its first atoms."""
    first = top_per_group(atoms, ["category"], [F.col("priority").desc(), F.col("atom_id")], most)
    line = F.concat(F.lit("- "), "name", F.lit(" ("), "atom_id", F.lit(")"))
    return first.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("l")).select("category", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("block"))


def wiki_atoms(atoms: DataFrame, related: int = 6) -> DataFrame:
    """atom_id, page: an article of each atom, with the first others of its category."""
    first = top_per_group(atoms.select("atom_id", "category", "priority"), ["category"], [F.col("priority").desc(), F.col("atom_id")], related)
    near = first.groupBy("category").agg(F.array_sort(F.collect_list("atom_id")).alias("near"))
    links = F.array_join(F.transform(F.filter("near", lambda x: x != F.col("atom_id")), lambda x: F.concat(F.lit("[["), x, F.lit("]]"))), ", ")
    page = F.concat(F.lit("# "), "name", F.lit("\nDefined by [["), "defined_by", F.lit("]]\nRelated: "), links)
    return atoms.join(near, "category").select("atom_id", page.alias("page"))
