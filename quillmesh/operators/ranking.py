"""Order-dependent operators as windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "place") -> DataFrame:
    """The first k rows of each group, with their place from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= k)


def diversify(rows: DataFrame, group: str, order: Sequence[Column], cap: int, limit: int) -> DataFrame:
    """The first rows, at most cap of a group until all else is used up: those beyond the cap come last, in the same order."""
    place = F.row_number().over(Window.partitionBy(F.coalesce(F.col(group), F.lit(""))).orderBy(*order))
    return rows.withColumn("over_cap", place > cap).orderBy("over_cap", *order).limit(limit)


def adjacent_groups(rows: DataFrame, partition: Sequence[str], order: Sequence[Column], value: Column, name: str = "run") -> DataFrame:
    """Number runs of equal neighbouring values."""
    w = Window.partitionBy(*partition).orderBy(*order)
    changed = (~value.eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return rows.withColumn("_changed", changed).withColumn(name, F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_changed")


def sampled_per_stratum(rows: DataFrame, strata: Sequence[str], key: Column, share: float) -> DataFrame:
    """max(1, round(share * n)) rows of each stratum, the first by a hash of their key."""
    n = F.count("*").over(Window.partitionBy(*strata))
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(F.md5(key.cast("string")), key))
    return rows.withColumn("place", place).withColumn("wanted", F.greatest(F.lit(1), F.bround(n * share))).filter("place <= wanted").drop("place", "wanted")
