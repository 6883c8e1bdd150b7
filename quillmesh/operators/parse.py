"""Parsers: Markdown, LaTeX and pre-labelled items to rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import section_type

# Patterns of LaTeX and bibliographies.
COMMENT = r"(?<!\\)%[^\n]*"
BIBITEM = r"(?s)\\bibitem(?:\[[^\]]*\])?\{([^}]+)\}(.*?)(?=\\bibitem|\\end\{thebibliography\}|$)"
BIB_FIELD = r"(?i)\b(title|author|year|url|journal|booktitle)\s*=\s*\{([^}]*)\}"
INLINE_CITATION = r"\[(\d{1,3}(?:\s*,\s*\d{1,3})*)\]"


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, COMMENT, "")


def bibitems(files: DataFrame) -> DataFrame:
    """doc_id, key, body of each \\bibitem."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(BIBITEM), F.lit(1)).alias("key"), F.regexp_extract_all("text", F.lit(BIBITEM), F.lit(2)).alias("body"))
    return files.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", F.trim("p.key").alias("key"), F.trim(F.regexp_replace("p.body", r"\s+", " ")).alias("body"))


def bib_fields(raw: Column) -> Column:
    """map of the known fields of a bibliography entry; of repeated ones, the last."""
    pairs = F.arrays_zip(F.transform(F.regexp_extract_all(raw, F.lit(BIB_FIELD), F.lit(1)), F.lower).alias("k"), F.regexp_extract_all(raw, F.lit(BIB_FIELD), F.lit(2)).alias("v"))
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))
    return last


def last_names(authors: Column) -> Column:
    """Lower-case last names of "Last, First and First Last" lists."""
    names = F.filter(F.split(authors, r"\s+and\s+|;"), lambda a: F.trim(a) != "")
    last = lambda a: F.when(a.contains(","), F.element_at(F.split(a, ","), 1)).otherwise(F.element_at(F.split(F.trim(a), r"\s+"), -1))
    return F.filter(F.transform(names, lambda a: F.regexp_replace(F.lower(last(a)), "[^a-z]", "")), lambda x: x != "")


def json_object(text: Column) -> Column:
    """From the first { to the last }, if that is JSON; else null."""
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    body = F.when((first > 0) & (F.instr(text, "}") > 0) & (last > first), F.substring(text, first, last - first + 1))
    return F.when(F.get_json_object(body, "$").isNotNull(), body)


def inline_citations(paragraphs: DataFrame) -> DataFrame:
    """paper_id, pos, marker, context of each number in [N] or [N, M], once a paragraph."""
    groups = F.regexp_extract_all("text", F.lit(INLINE_CITATION), F.lit(1))
    numbers = F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda n: F.trim(n)))))
    return paragraphs.select("paper_id", "pos", F.explode(numbers).alias("number"), F.substring("text", 1, 400).alias("context")).select("paper_id", "pos", F.concat(F.lit("["), "number", F.lit("]")).alias("marker"), "context")


def markdown(files: DataFrame) -> DataFrame:
    """doc_id, section, title, section_type, paragraph, text: headings open sections, blank lines end paragraphs.

    Running counts over the lines number both; a file's lines are one partition of the window.
    """
    lines = files.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    order = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading, blank = F.col("line").rlike("^#{1,4} "), F.trim("line") == ""
    run = lines.withColumn("heading", heading).withColumn("section", F.sum(heading.cast("int")).over(order)).withColumn("block", F.sum((heading | blank).cast("int")).over(order))
    run = run.withColumn("title", F.last(F.when(F.col("heading"), F.regexp_replace("line", "^#+ ", "")), ignorenulls=True).over(order))
    body = run.filter(~F.col("heading") & (F.trim("line") != ""))
    paragraphs = body.groupBy("doc_id", "section", "title", "block").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    number = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("block"))
    return paragraphs.select("doc_id", "section", "title", section_type(F.coalesce("title", F.lit(""))).alias("section_type"), number.alias("paragraph"), F.array_join(F.transform("l", lambda x: x["line"]), " ").alias("text"))


def labelled_items(items: DataFrame) -> DataFrame:
    """doc_id, section, title, paragraph, text, is_reference of labelled items (doc_id, at, label, text).

    Section headers open sections; page furniture and captions are skipped; after a header that names
    references, items are references; items before any header are of the section Body.
    """
    order = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = items.filter(~F.col("label").isin("page_header", "page_footer", "footnote", "caption"))
    head = F.col("label") == "section_header"
    run = kept.withColumn("section", F.sum(head.cast("int")).over(order)).withColumn("title", F.coalesce(F.last(F.when(head, F.col("text")), ignorenulls=True).over(order), F.lit("Body")))
    body = run.filter(F.col("label") != "section_header")
    number = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("at"))
    return body.select("doc_id", "section", "title", number.alias("paragraph"), "text", F.lower("title").rlike("reference|bibliograph").alias("is_reference"))


def expand_inputs(files: DataFrame, deepest: int = 6) -> DataFrame:
    """doc_id, name, text -> doc_id, text: each document's root (name main) with \\input and \\include put in, cycles and depth guarded."""
    pattern = re.compile(r"\\(?:input|include)\{([^}]+)\}")

    def expanded(files: Iterable[dict[str, str]]) -> str:
        texts = {f["name"]: f["text"] for f in files}

        def put(name: str, seen: tuple[str, ...]) -> str:
            name = name.removesuffix(".tex")
            if name in seen or len(seen) > deepest or name not in texts:
                return ""
            return pattern.sub(lambda m: put(m[1].strip(), (*seen, name)), texts[name])

        return put("main", ())

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"doc_id": part["doc_id"], "text": [expanded(files) for files in part["files"]]})

    grouped = files.groupBy("doc_id").agg(F.collect_list(F.struct("name", "text")).alias("files"))
    return grouped.mapInPandas(run, "doc_id long, text string")


def bib_entries(files: DataFrame) -> DataFrame:
    """doc_id, key, raw ("k={v}" pairs) of .bib files; braces nest."""

    def entries(text: str) -> Iterator[tuple[str, str]]:
        for m in re.finditer(r"@\w+\s*\{\s*([^,\s]+)\s*,", text):
            depth, i = 1, m.end()
            while i < len(text) and depth:
                depth += {"{": 1, "}": -1}.get(text[i], 0)
                i += 1
            body = text[m.end() : i - 1]
            fields = [f"{k.lower()}={{{v.strip()}}}" for k, v in re.findall(r"(\w+)\s*=\s*[{\"]((?:[^{}\"]|\{[^{}]*\})*)[}\"]", body)]
            yield m[1], " ".join(fields)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame([(i, k, raw) for i, t in zip(part["doc_id"], part["text"], strict=True) for k, raw in entries(t or "")], columns=["doc_id", "key", "raw"])

    return files.select("doc_id", "text").mapInPandas(run, "doc_id long, key string, raw string")


def tex_document(files: DataFrame) -> DataFrame:
    """doc_id, kind (section, paragraph, equation, citation), id, section, text of LaTeX sources."""
    token = re.compile(r"\\(?:sub)*section\*?\{(?P<title>[^}]*)\}|\\begin\{(?P<env>equation|align|gather)\*?\}(?P<body>.*?)\\end\{(?P=env)\*?\}|\$\$(?P<inline>.+?)\$\$|(?P<blank>\n\s*\n)", re.DOTALL)

    def rows(doc_id: int, text: str) -> Iterator[tuple]:
        text = re.sub(COMMENT, "", text or "")
        m = re.search(r"\\begin\{document\}(.*?)(?:\\end\{document\}|\Z)", text, re.DOTALL)
        text = m[1] if m else text
        section = paragraph = equation = 0
        hold: list[str] = []

        def close() -> Iterator[tuple]:
            nonlocal paragraph
            body = re.sub(r"\s+", " ", "".join(hold)).strip()
            hold.clear()
            if body:
                paragraph += 1
                ident = f"sec-{section}-p{paragraph}"
                for key in dict.fromkeys(k.strip() for c in re.findall(r"\\cite[a-z]*\{([^}]+)\}", body) for k in c.split(",")):
                    yield doc_id, "citation", key, f"sec-{section}", ident
                yield doc_id, "paragraph", ident, f"sec-{section}", re.sub(r"\\cite[a-z]*\{[^}]+\}", "[cite]", body)

        at = 0
        for t in token.finditer(text):
            hold.append(text[at : t.start()])
            at = t.end()
            if t["title"] is not None:
                yield from close()
                section, paragraph = section + 1, 0
                yield doc_id, "section", f"sec-{section}", None, t["title"].strip()
            elif t["blank"] is not None:
                yield from close()
            else:
                equation += 1
                yield doc_id, "equation", f"eq-{equation}", f"sec-{section}", (t["body"] or t["inline"]).strip()
        hold.append(text[at:])
        yield from close()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame([r for i, t in zip(part["doc_id"], part["text"], strict=True) for r in rows(i, t)], columns=["doc_id", "kind", "id", "section", "text"])

    return files.select("doc_id", "text").mapInPandas(run, "doc_id long, kind string, id string, section string, text string")
