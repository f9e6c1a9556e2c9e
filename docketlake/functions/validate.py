"""Row validators: each gives null, or the text of its error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlake import dictionaries as D


def error_if(bad: Column, message: str) -> Column:
    """The message where ``bad`` holds (null counts as bad)."""
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(message))


def errors(*checks: Column) -> Column:
    """The errors that there are."""
    return F.array_compact(F.array(*checks))


def url(c: Column) -> Column:
    return error_if(~F.trim(c).rlike(r"^https?://[^/?#\s]+"), "invalid url")


def content(c: Column, least: int = 10, most: int = 10_000_000) -> Column:
    t = F.trim(c)
    letters = F.length(t) - F.length(F.regexp_replace(t, r"\p{L}+", ""))
    return F.when(F.coalesce(t, F.lit("")) == "", "empty").when(F.length(t) < least, "too short").when(F.length(t) > most, "too long").when(letters < 0.1 * F.length(t), "too few letters")


def between(c: Column, low, high, name: str) -> Column:
    return error_if(~c.between(low, high), f"{name} out of range")


def length_between(c: Column, low: int, high: int, name: str) -> Column:
    return error_if(~F.length(F.trim(c)).between(low, high), f"{name} length")


def keyword(c: Column) -> Column:
    return length_between(c, 3, 200, "keyword")


def language(c: Column) -> Column:
    return error_if(~F.lower(F.trim(c)).rlike("^[a-z]{2,3}$"), "invalid language")


def known_language(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(D.LANGUAGES)


def date_range(start: Column, end: Column, as_of: Column) -> Column:
    ahead = F.add_months(as_of, 120)
    return F.when(start > end, "start after end").when(F.datediff(end, start) > 36500, "range too long").when((start > ahead) | (end > ahead), "too far ahead")


def search_query(c: Column) -> Column:
    t = F.trim(c)
    dangerous = reduce(lambda a, b: a | b, [F.lower(t).rlike(p) for p in D.INJECTION_PATTERNS])
    return F.when(F.coalesce(t, F.lit("")) == "", "empty query").when(~F.length(t).between(2, 1000), "query length").when(dangerous, "dangerous query")


def identifiers(c: Column) -> Column:
    """A map with a primary_id of 3 to 200 characters."""
    return F.when(c.isNull() | (F.size(c) == 0), "no identifiers").otherwise(length_between(F.try_element_at(c, F.lit("primary_id")), 3, 200, "primary_id"))


RANGES = {"confidence": (0.0, 1.0), "priority": (1, 10), "max_pages": (1, 10000), "delay": (0, 60), "timeout": (1, 600), "retries": (0, 10), "limit": (1, 100), "offset": (0, 10000)}


def ranged(name: str, c: Column, nullable: bool = False) -> Column:
    """The check of a named number."""
    low, high = RANGES[name]
    check = between(c, low, high, name)
    return F.when(c.isNotNull(), check) if nullable else check
