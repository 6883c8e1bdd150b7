"""Identifiers of papers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of ids, and of a URL's scheme, host and path.
ARXIV = r"\d{4}\.\d{4,5}"
DOI = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"
HEX = r"(?i)([0-9a-f]{40})/?$"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def normalize_id(token: Column) -> Column:
    """URL or id -> ARXIV:x, DOI:x, a hexadecimal id, or what is left.

    A URL's host decides first; otherwise the path (what follows a scheme) must be an id entire.
    """
    s = F.trim(token)
    host = F.regexp_extract(s, SCHEME + r"//([^/?#]*)", 1)
    path = F.regexp_extract(s, SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1)
    rest = F.when(s.rlike(SCHEME) & (path != ""), path).otherwise(s)
    arxiv = lambda x: F.concat(F.lit("ARXIV:"), F.regexp_extract(x, f"({ARXIV})", 1))
    return (
        F.when(host.contains("arxiv.org") & path.rlike(ARXIV), arxiv(path))
        .when(host.contains("doi.org") & path.rlike(DOI), F.concat(F.lit("DOI:"), F.regexp_extract(path, DOI, 0)))
        .when(host.contains("semanticscholar.org") & path.rlike("(?i)/[0-9a-f]{40}/?$"), F.regexp_extract(path, HEX, 1))
        .when(rest.rlike(rf"^(?i)(?:arxiv[:/])?{ARXIV}(?:v\d+)?$"), arxiv(rest))
        .when(rest.rlike("^" + DOI + "$"), F.concat(F.lit("DOI:"), rest))
        .otherwise(rest)
    )
