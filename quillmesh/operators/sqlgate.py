"""Read-only SQL over the graph's tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

#: Logical plans that only read: what a parsed statement may be at its top.
_READ = {"Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Distinct", "Union", "Intersect", "Except", "UnresolvedWith", "WithCTE", "SubqueryAlias", "UnresolvedHaving", "Join", "Window", "Pivot", "OneRowRelation", "UnresolvedInlineTable", "UnresolvedRelation", "Offset"}


class Refused(ValueError):
    """Not one read-only statement."""


class Gate:
    """Runs one SELECT over named tables; anything else is refused before it is planned."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.tables = spark, tables

    def frame(self, sql: str, args: Sequence[Any] = ()) -> DataFrame:
        """The statement's rows, lazily. Raises Refused."""
        text = sql.strip().removesuffix(";").rstrip()
        if ";" in text:
            raise Refused("one statement only")
        if not text.lower().startswith(("select", "with")):
            raise Refused("SELECT or WITH only")
        try:
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        except Exception as e:
            raise Refused(f"not SQL: {str(e).splitlines()[0][:200]}") from None
        if plan.nodeName() not in _READ:
            raise Refused(f"{plan.nodeName()} is no query")
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text, args=list(args) or None)

    def run(self, sql: str, args: Sequence[Any] = (), limit: int = 100) -> dict[str, Any]:
        """columns, rows (at most limit) and whether there are more; or error."""
        try:
            df = self.frame(sql, args)
            rows = df.limit(limit + 1).collect()
        except (Refused, PySparkException) as e:
            return {"error": str(e).splitlines()[0]}
        return {"columns": df.columns, "rows": [r.asDict(recursive=True) for r in rows[:limit]], "truncated": len(rows) > limit}
