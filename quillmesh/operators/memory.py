"""Append logs, session notes and promoted answers: text in, rows out, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decision_entry(timestamp: Column, slug: Column, body: dict[str, Column]) -> Column:
    lines = [F.concat(F.lit(f"**{k}:** "), v, F.lit("\n")) for k, v in body.items()]
    return F.concat(F.lit("## "), timestamp, F.lit(" · "), slug, F.lit("\n"), *lines)


def parse_decisions(files: DataFrame) -> DataFrame:
    """text -> timestamp, slug, body (a map of the bold keys), one row per second-level heading."""
    entries = files.select(F.explode(F.split("text", r"\n(?=## )|^(?=## )")).alias("entry")).filter(F.col("entry").startswith("## "))
    keys, values = (F.regexp_extract_all("entry", F.lit(r"(?m)^\*\*([^:*]+):\*\* ?(.*)$"), F.lit(i)) for i in (1, 2))
    head = r"^## (\S+) · (\S*)"
    return entries.select(F.regexp_extract("entry", head, 1).alias("timestamp"), F.regexp_extract("entry", head, 2).alias("slug"), F.map_from_arrays(keys, values).alias("body"))


def session_notes(turns: DataFrame) -> DataFrame:
    """conv_id, name, text: one note per conversation."""
    line = F.struct("turn", F.concat(F.lit("- "), F.regexp_replace("text", r"\s+", " ")).alias("line"), "role")
    lines = lambda role: F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == role), lambda t: t["line"]), "\n")
    day = F.lpad((1 + F.col("conv_id") % 28).cast("string"), 2, "0")
    stem = F.concat(F.lit("2024-01-"), day, F.lit("-talk-"), F.col("conv_id").cast("string"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("turns"))
    return rows.select("conv_id", F.concat(stem, F.lit(".md")).alias("name"), F.concat(F.lit("# Session "), stem, F.lit("\n\n## Done\n"), lines("assistant"), F.lit("\n\n## Next\n"), lines("user"), F.lit("\n")).alias("text"))


def list_sessions(notes: DataFrame) -> DataFrame:
    """Notes with their number of bullets and whether a next step is named."""
    following = F.regexp_extract("text", r"(?s)\n## Next\n(.*)$", 1)
    return notes.select("conv_id", "name", F.size(F.filter(F.split("text", "\n"), lambda x: x.startswith("- "))).cast("long").alias("bullets"), following.contains("- ").alias("next_step")).filter(F.col("name").rlike(r"^\d{4}-\d{2}-\d{2}-.*\.md$"))


def parse_sessions(notes: DataFrame) -> DataFrame:
    """conv_id, section, place, item: the bullets under each second-level heading."""
    parts = notes.select("conv_id", F.explode(F.split("text", r"\n(?=## )")).alias("part")).filter(F.col("part").startswith("## "))
    items = F.filter(F.split("part", "\n"), lambda x: x.startswith("- "))
    return parts.select("conv_id", F.regexp_extract("part", "^## (.*)", 1).alias("section"), F.posexplode(items).alias("place", "item"))


def append_bullet(notes: DataFrame, section: str, item: Column) -> DataFrame:
    """Notes with an item at the end of a section; the section is made where it is missing."""
    bullet = F.concat(F.lit("- "), item, F.lit("\n"))
    found = F.col("text").contains(f"## {section}\n")
    parts = F.split("text", r"\n(?=## )")
    grown = F.transform(parts, lambda p: F.when(p.startswith(f"## {section}\n"), F.concat(F.regexp_replace(p, r"\n+$", ""), F.lit("\n"), bullet)).otherwise(p))
    return notes.withColumn("text", F.when(found, F.array_join(grown, "\n")).otherwise(F.concat("text", F.lit(f"\n## {section}\n"), bullet)))


def parse_answers(pages: DataFrame) -> DataFrame:
    """slug, sources, body of pages with or without front matter; blank pages are left out."""
    front = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---\n", 1)
    listed = F.regexp_extract(front, r"(?m)^source_atom_uids:\s*\[(.*)\]\s*$", 1)
    sources = F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(x)), lambda x: x != "")
    named = F.regexp_extract(front, r"(?m)^slug:\s*(\S+)\s*$", 1)
    body = F.trim(F.regexp_replace("text", r"(?s)^---\n.*?\n---\n", ""))
    return pages.filter(F.trim("text") != "").select("*", F.when(named == "", F.col("stem")).otherwise(named).alias("slug"), sources.alias("sources"), body.alias("body"))


def replace_answers(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks without earlier answers, and the fresh ones as answers of no paper."""
    answers = fresh.select("chunk_id", F.lit("answer").alias("chunk_kind"), F.lit(0.8).alias("quality"), F.lit(None).cast("string").alias("paper_id"))
    return answers.unionByName(chunks.filter("chunk_kind <> 'answer'"))
