"""Optional models: they see only the rows that rules leave unsure, within a budget. Off unless given."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: contexts -> for each, pairs of a label and a confidence.
Labeller = Callable[[list[str]], list[list[tuple[str, float]]]]


def unsure(rows: DataFrame, confidence: Column, below: float, budget: int, key: str) -> DataFrame:
    """The rows under a confidence, the least sure first, as many as the budget allows."""
    return rows.filter(confidence < below).orderBy(confidence, key).limit(budget)


def labelled(rows: DataFrame, key: str, text: str, model: Labeller, labels: Sequence[str], keep_order: bool = False, most: int = 3) -> DataFrame:
    """key, labels (array<struct<label, confidence>>): the model's answers, unknown labels dropped, confidences within 0 and 1.

    keep_order leaves the answers in the model's order; else they are sorted by confidence.
    """
    known = set(labels)
    kind = pa.list_(pa.struct([("label", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for answers in model([t or "" for t in batch.column(1).to_pylist()]):
                good = [(label, min(1.0, max(0.0, float(c)))) for label, c in answers if label in known]
                good = good if keep_order else sorted(good, key=lambda x: -x[1])
                out.append([{"label": label, "confidence": c} for label, c in good[:most]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=[key, "labels"])

    return rows.select(F.col(key).cast("string").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(run, f"{key} string, labels array<struct<label: string, confidence: double>>")


def refined(rows: DataFrame, key: str, answers: DataFrame, column: str) -> DataFrame:
    """rows with the model's labels in the place of the rules' where it gave any."""
    given = answers.filter(F.size("labels") > 0).select(F.col(key), F.col("labels").alias("_given"))
    return rows.join(given, key, "left").withColumn(column, F.coalesce("_given", F.col(column))).drop("_given")


def reranked(items: DataFrame, question: str, text: str, model: Callable[[str, list[str]], list[float]], limit: int) -> DataFrame:
    """A question's few items by a model's scores of (question, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model(question, batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "model_score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    scored = items.mapInArrow(run, f"{kinds}, model_score double")
    return scored.withColumn("place", F.row_number().over(Window.orderBy(F.col("model_score").desc()))).filter(F.col("place") <= limit).drop("place")
