"""What a recognised text tells about its document, and texts of ranges of pages. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake import dictionaries as D
from docketlake.functions.text import engine_form

#: Lines at the top that may name an authority, or be the title; their lengths (more than, and for titles less than).
AUTHORITY_LINES, TITLE_LINES, SHORTEST, LONGEST = 10, 5, 10, 100


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def holds_any(c: Column, words: list[str]) -> Column:
    """Whether any of the words is part of the lower-cased text."""
    out = F.lit(False)
    for w in words:
        out = out | F.lower(c).contains(w)
    return out


def first_line(text: Column, lines: int, good) -> Column:
    """The first of the top lines, white space at its ends taken off, that is good; null without one."""
    top = F.transform(F.slice(F.split(text, "\n"), 1, lines), stripped)
    return F.get(F.filter(top, good), 0)


def document_metadata(text: Column, numbers: list[str] | None = None) -> Column:
    """First and second date (by pattern, then place), number by the first pattern that finds one, authority and title
    among the top lines, type by the first group of words, signatures, and the share of date, authority, type and title
    that was found. ``numbers`` are the patterns of numbers; without them these are ``RECOGNISED_NUMBERS``."""
    t = F.coalesce(text, F.lit(""))
    dates = F.concat(*[F.regexp_extract_all(t, F.lit(engine_form(p)), F.lit(0)) for p in D.RECOGNISED_DATES])
    number = F.coalesce(*[F.nullif(F.regexp_extract(t, engine_form(p, True), 1), F.lit("")) for p in numbers or D.RECOGNISED_NUMBERS])
    who = first_line(t, AUTHORITY_LINES, lambda x: holds_any(x, D.AUTHORITY_WORDS) & (F.length(x) > SHORTEST))
    capital = lambda x: (F.upper(x) == x) & (F.lower(x) != x)
    title = first_line(t, TITLE_LINES, lambda x: (F.length(x) > SHORTEST) & (F.length(x) < LONGEST) & (capital(x) | holds_any(x, D.TITLE_WORDS)))
    kind = F.coalesce(*[F.when(holds_any(t, words), k) for k, words in D.RECOGNISED_TYPES.items()])
    signs = F.array_compact(F.array(*[F.when(F.lower(t).contains(w), F.lit(w)) for w in D.SIGNATURE_WORDS]))
    date = F.get(dates, 0)
    sure = sum((F.when(c.isNotNull(), 0.25).otherwise(0.0) for c in (date, who, kind, title)), F.lit(0.0))
    return F.struct(date.alias("document_date"), F.get(dates, 1).alias("effective_date"), number.alias("document_number"), who.alias("issuing_authority"), kind.alias("document_type"), title.alias("document_title"), signs.alias("signatures"), sure.alias("confidence"))


def page_range(pages: DataFrame, by: str, number: str, text: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Texts of a document's pages from ``first`` to ``last`` (from 1, both included), blank ones skipped, each after a
    line with its number: pages_processed, total_text_length, text_content, success. Documents without a page of the
    range have no row."""
    n = F.col(number)
    kept = pages.where((n >= max(first or 1, 1)) & (n <= last if last is not None else F.lit(True)))
    blank = stripped(F.coalesce(F.col(text), F.lit(""))) == ""
    piece = F.struct(n.alias("n"), F.concat(F.lit("\n--- Page "), n.cast("string"), F.lit(" ---\n"), F.col(text)).alias("t"))
    held = kept.groupBy(by).agg(F.count("*").alias("pages_processed"), F.sort_array(F.collect_list(F.when(~blank, piece))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["t"]), "")
    return held.select(by, "pages_processed", F.length(whole).alias("total_text_length"), whole.alias("text_content"), (F.size("p") > 0).alias("success"))
