"""Licence scanning by canonical digests.

A text is made canonical: A-Z lower-cased, copyright lines dropped, ASCII punctuation and typographic
quotes and dashes turned to blanks, blanks collapsed, equivalent spellings unified. The SHA-256 of
the canonical text is hash-joined to the digests of known licences, made canonical the same way. The
units that are looked up entire are each whole text and each of its lines (for one-line notices).
The table of known digests is a fixed list: broadcast for the texts, a literal set for their lines.
Each row is made canonical once and gets its own answer; nothing is shuffled.

Edge cases. Null or empty text, or one of punctuation only: no digest, no licence. Null doc_id: kept
as null, looked up like others. Repeated rows: alike; rows of one id and different texts: each its own
answer. A notice that occurs twice in a document counts once a place; licences of equal digest
can't be, names are listed once, in order. Very long texts: whole. Empty table: no rows. Columns other than
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.texts import DIGESTS, KNOWN

# What canonical form drops and unifies, in this order. They read alike in Java, RE2 and Python.
COPYRIGHT = r"(^|\n)[^\na-z0-9]*(copyright *(\(c\)|©|[0-9]{4}|<year>|\[year\]|\[yyyy\])|\(c\) *[0-9]{4}|©)[^\n]*"
BLANKS = r"[\x00-\x09\x0b-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f“”‘’„«»–—…]+"
SPELLINGS = (
    ("all rights reserved", ""), ("licence", "license"), ("organisation", "organization"), ("authorisation", "authorization"), ("favour", "favor"), ("behaviour", "behavior"),
    ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("per cent", "percent"), ("sub license", "sublicense"), ("http www", "https www"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(text: str) -> str:
    """Cased down, without copyright lines and punctuation; lines kept."""
    return re.sub(BLANKS, " ", re.sub(COPYRIGHT, r"\1", text.translate(str.maketrans(UPPER, LOWER))))


def spelt(text: str) -> str:
    for a, b in SPELLINGS:
        text = text.replace(a, b)
    return re.sub(" +", " ", text).strip(" ")


def whole(text: str) -> str:
    """The canonical form of an entire text, however it is broken into lines; for known texts and tests."""
    return spelt(re.sub("[ \n]+", " ", plain(text)))


def known() -> list[tuple[str, str]]:
    """(digest, licence) of the known texts."""
    return sorted([(hashlib.sha256(whole(t).encode()).hexdigest(), name) for name, t in KNOWN] + [(d, name) for name, d in DIGESTS])


def plain_column(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT, "$1"), BLANKS, " ")


def spelt_column(text: Column) -> Column:
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(text, "  +", " "))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the whole text), license (of the whole text), n_notices, notices (licences of lines) for every row of docs."""
    spark = docs.sparkSession
    fixed = known()
    table = F.broadcast(spark.createDataFrame(fixed, "known string, name string"))  # a fixed list
    names = F.create_map(*[F.lit(x) for pair in fixed for x in pair])
    digest_of = lambda x: F.sha2(x.cast("binary"), 256)

    def looked_up(c: Column) -> Column:
        one = spelt_column(F.regexp_replace(c, "[ \n]+", " "))
        lines = F.transform(F.split(c, "\n"), lambda line: digest_of(spelt_column(line)))
        return F.struct(F.when(one != "", digest_of(one)).alias("digest"), F.filter(lines, lambda d: d.isin([k for k, _ in fixed])).alias("hits"))

    seen = docs.select("doc_id", F.get(F.transform(F.array(plain_column(F.coalesce(F.col("text").cast("string"), F.lit("")))), looked_up), F.lit(0)).alias("found"))
    out = seen.join(table, F.col("found.digest") == F.col("known"), "left")
    listed = F.array_join(F.array_sort(F.array_distinct(F.transform("found.hits", lambda d: F.element_at(names, d)))), ",")
    return out.select("doc_id", F.col("found.digest").alias("digest"), F.col("name").alias("license"), F.size("found.hits").cast("long").alias("n_notices"), listed.alias("notices"))


def oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    c = f"regexp_replace(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {quote(COPYRIGHT)}, '\\1', 'g'), {quote(BLANKS)}, ' ', 'g')"

    def spelt_sql(x: str) -> str:
        for a, b in SPELLINGS:
            x = f"replace({x}, {quote(a)}, {quote(b)})"
        return f"trim(regexp_replace({x}, ' +', ' ', 'g'))"

    digests, names = ("[" + ", ".join(quote(x[i]) for x in known()) + "]" for i in range(2))
    return f"""
WITH c AS (SELECT doc_id, {c} AS c FROM documents),
e AS (SELECT doc_id, {spelt_sql("regexp_replace(c, '[ \\n]+', ' ', 'g')")} AS one,
  [n FOR n IN [list_position({digests}, sha256({spelt_sql("line")})) FOR line IN string_split(c, chr(10))] IF n > 0] AS hits FROM c),
w AS (SELECT doc_id, hits, CASE WHEN one <> '' THEN sha256(one) END AS digest FROM e)
SELECT doc_id, digest, CASE WHEN list_position({digests}, digest) > 0 THEN ({names})[list_position({digests}, digest)] END AS license, CAST(len(hits) AS BIGINT) AS n_notices,
  array_to_string(list_sort(list_distinct([({names})[n] FOR n IN hits])), ',') AS notices
FROM w
"""
