"""String expressions shared by the operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENDS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def strip(c) -> Column:
    """Without blanks of any kind and line breaks at both ends."""
    return F.regexp_replace(c, _ENDS, "")


def shown(c) -> Column:
    """True where the text holds more than blanks; null and empty texts are false."""
    return F.coalesce(F.regexp_like(c, F.lit(r"[^\s\p{Z}]")), F.lit(False))


def or_empty(c) -> Column:
    return F.coalesce(c, F.lit(""))


def non_blank(c) -> Column:
    """The text, or null where it shows nothing."""
    return F.when(shown(c), c)


def sql_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def sql_shown(c: str) -> str:
    return f"(coalesce(length({sql_strip(c)}), 0) > 0)"
