"""Documents from several backends: tables of labelled items, references and equations of Markdown, one backend after the other."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A displayed equation within a line; a heading.
EQUATION = r"\$\$(.+?)\$\$"
HEADING = r"^(#{1,4}) +(.*)$"


def table_caption(caption_text: Column, captions: Column, caption: Column) -> Column:
    """What the item says of itself, else its captions joined, else its plain caption; never null."""
    joined = F.trim(F.array_join(F.filter(captions, lambda c: c.isNotNull()), " "))
    return F.coalesce(F.nullif(caption_text, F.lit("")), F.nullif(joined, F.lit("")), caption, F.lit(""))


def table_rows(grid: Column) -> Column:
    """A table's cells as array<array<string>>; null where the backend gave no grid."""
    return F.when(F.size(grid) > 0, F.transform(grid, lambda row: F.transform(row, lambda cell: F.coalesce(cell["text"], F.lit("")))))


def tables(items: DataFrame) -> DataFrame:
    """doc_id, id, section, caption, rows of the items labelled table, numbered in order.

    items: doc_id, at, label, text, caption_text, captions (array<string>), caption, grid (array<array<struct<text>>>).
    """
    order = Window.partitionBy("doc_id").orderBy("at")
    head = F.col("label") == "section_header"
    placed = items.withColumn("section", F.sum(head.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = placed.filter("label = 'table'").withColumn("n", F.row_number().over(order))
    caption = table_caption(F.col("caption_text"), F.col("captions"), F.col("caption"))
    return own.select("doc_id", F.concat(F.lit("tab-"), F.col("n").cast("string")).alias("id"), F.when(F.col("section") > 0, F.concat(F.lit("sec-"), F.col("section").cast("string"))).alias("section"), caption.alias("caption"), table_rows(F.col("grid")).alias("rows"))


def _lines(files: DataFrame) -> DataFrame:
    """doc_id, at, line, section, in_refs of the lines that aren't headings; a heading that names references opens them, the next one ends them."""
    lines = files.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    order = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.col("line").rlike(HEADING)
    title = F.lower(F.regexp_extract("line", HEADING, 2))
    run = lines.select("doc_id", "at", "line", heading.alias("heading"), F.sum(heading.cast("int")).over(order).alias("section"), F.last(F.when(heading, title.contains("reference") | title.contains("bibliograph")), ignorenulls=True).over(order).alias("in_refs"))
    return run.filter(~F.col("heading")).select("doc_id", "at", "line", "section", F.coalesce("in_refs", F.lit(False)).alias("in_refs"))


def markdown_references(files: DataFrame) -> DataFrame:
    """doc_id, ref_id, marker, raw: each line under a heading of references, numbered through the document."""
    kept = _lines(files).filter(F.col("in_refs") & (F.trim("line") != ""))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).cast("string")
    return kept.select("doc_id", F.concat(F.lit("ref-"), n).alias("ref_id"), F.concat(F.lit("["), n, F.lit("]")).alias("marker"), F.trim("line").alias("raw"))


def markdown_equations(files: DataFrame) -> DataFrame:
    """doc_id, id, section, latex of each displayed equation outside the references, numbered through the document."""
    found = _lines(files).filter(~F.col("in_refs")).select("doc_id", "at", "section", F.posexplode(F.regexp_extract_all("line", F.lit(EQUATION), F.lit(1))).alias("pos", "latex"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "pos")).cast("string")
    return found.select("doc_id", F.concat(F.lit("eq-"), n).alias("id"), F.when(F.col("section") > 0, F.concat(F.lit("sec-"), F.col("section").cast("string"))).alias("section"), F.trim("latex").alias("latex"))


Backend = Callable[[DataFrame], DataFrame]


def parsed_in_turn(files: DataFrame, backends: Sequence[tuple[str, str, Backend]]) -> DataFrame:
    """doc_id, backend and the rows of the first backend of a file's kind that gives any; a file without rows comes back once with nulls.

    files: doc_id, kind, text. backends: name, the kind that it reads, and a function of (doc_id, text)
    to rows with doc_id; all give the same columns. A later backend sees only files that no earlier one
    could read, so each file is parsed by as few as need be.
    """
    left, done = files, None
    for name, kind, backend in backends:
        rows = backend(left.filter(F.col("kind") == kind).select("doc_id", "text")).withColumn("backend", F.lit(name))
        done = rows if done is None else done.unionByName(rows)
        left = left.join(rows.select("doc_id").distinct(), "doc_id", "left_anti")
    if done is None:
        return files.select("doc_id", F.lit(None).cast("string").alias("backend"))
    return done.unionByName(left.select("doc_id"), allowMissingColumns=True)


def graded(leaves: DataFrame, answers: DataFrame) -> DataFrame:
    """leaf_id, status, rationale of a model's answers (leaf_id, answer): the object from the first { to the last }.

    No object at all, or one that isn't JSON: fail, and why. No status in it: fail. Rationales are cut to 200 characters.
    """
    first, last = F.instr("answer", "{"), F.length("answer") - F.instr(F.reverse("answer"), "}") + 1
    there = (first > 0) & (F.instr("answer", "}") > 0) & (last > first)
    body = F.when(there, F.substring("answer", first, last - first + 1))
    good = F.get_json_object(body, "$").isNotNull()
    status = F.when(good, F.coalesce(F.get_json_object(body, "$.status"), F.lit("fail"))).otherwise(F.lit("fail"))
    why = F.when(~F.coalesce(there, F.lit(False)), "grader did not return JSON").when(~good, "json decode failed").otherwise(F.substring(F.coalesce(F.get_json_object(body, "$.rationale"), F.lit("")), 1, 200))
    return leaves.select("leaf_id").join(answers, "leaf_id", "left").select("leaf_id", status.alias("status"), why.alias("rationale"))
