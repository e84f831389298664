"""Text expressions with the semantics that the operators are defined by: code points and Unicode white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: the Unicode property, and the four separators U+001C to U+001F.
WS = r"[\s\x1c-\x1f]"
_EDGES = rf"(?U)\A{WS}+|{WS}+\z"


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, _EDGES, "")


def is_blank(c: Column | str) -> Column:
    """Null, empty, or white space only."""
    return F.coalesce(strip(c), F.lit("")) == ""


def word_count(c: Column | str) -> Column:
    """Runs of anything but white space."""
    return F.size(F.filter(F.split(c, rf"(?U){WS}+"), lambda w: w != ""))


def is_upper(c: Column | str) -> Column:
    """At least one cased character, and none in lower or title case; ordinal indicators count as lower case."""
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(r"\p{IsUppercase}") & ~c.rlike(r"[\p{IsLowercase}\p{Lt}]")


def joined(rows: Column, field: str, separator: str) -> Column:
    """One field of an array of structs, joined by a separator."""
    return F.array_join(F.transform(rows, lambda r: r[field]), separator)
