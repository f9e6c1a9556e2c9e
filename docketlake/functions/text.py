"""Text measures as Column expressions. Null texts count as empty."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def total(columns: list[Column]) -> Column:
    return reduce(add, columns)


def substring_count(c: Column, word: str) -> Column:
    """Non-overlapping occurrences of ``word``, inside other words too."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("long")


def keyword_total(c: Column, words: list[str]) -> Column:
    """Occurrences of all words in the lower-cased text."""
    low = F.lower(c)
    return total([substring_count(low, w) for w in words])


def word_total(c: Column, words: list[str]) -> Column:
    """As keyword_total, whole ASCII words only."""
    return F.regexp_count(F.lower(c), F.lit(r"\b(?:" + "|".join(words) + r")\b")).cast("long")


def presence_count(c: Column, words: list[str]) -> Column:
    """How many of the words occur in the lower-cased text."""
    low = F.lower(c)
    return total([low.contains(w).cast("long") for w in words])


def engine_form(pattern: str, ignore_case: bool = False) -> str:
    """A pattern of Python's re for the engine: classes and word boundaries mean Unicode there, as they do in Python."""
    return ("(?iuU)" if ignore_case else "(?U)") + pattern


def regex_total(c: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    """Matches of all patterns. A text without a digit isn't searched for a pattern that needs one."""
    digit = c.rlike(r"\p{Nd}")

    def matches(p: str) -> Column:
        n = F.regexp_count(c, F.lit(engine_form(p, ignore_case))).cast("long")
        return F.when(digit, n).otherwise(F.lit(0).cast("long")) if needs_digit(p) else n

    return total([matches(p) for p in patterns])


def needs_digit(pattern: str) -> bool:
    """Whether every branch of the pattern holds a digit (no text matches it without)."""
    return all("\\d" in branch.replace("\\d*", "") for branch in pattern.split("|"))


def broken_references(c: Column, refs: Column) -> Column:
    """References (names of sections) that the text has no section for, whatever the case."""
    low = F.lower(c)
    return F.filter(refs, lambda r: ~F.rlike(low, F.concat(F.lit("(?U)section\\s+\\Q"), F.lower(r), F.lit("\\E"))))


def word_count(c: Column) -> Column:
    """Words between white space; 0 for a blank text."""
    return F.regexp_count(c, F.lit(r"\S+")).cast("long")


def paragraph_count(c: Column) -> Column:
    """Non-blank blocks between empty lines."""
    return F.size(F.filter(F.split(c, "\n\n"), lambda p: F.trim(p) != "")).cast("long")


def first_group(c: Column, patterns: list[str], group: int = 1) -> Column:
    """The first pattern's group that is not empty; null if none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, group), F.lit("")) for p in patterns])


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def labels_present(c: Column, groups: dict[str, list[str]]) -> Column:
    """Names of the groups of which any word occurs."""
    low = F.lower(c)
    return F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [low.contains(w.lower()) for w in words]), F.lit(name)) for name, words in groups.items()]))


def best_label(c: Column, groups: dict[str, list[str]], default: str | None = None) -> Column:
    """The group with most occurrences; the first wins ties; ``default`` if none occurs."""
    low = F.lower(c)
    scores = F.array(*[F.struct(total([substring_count(low, w) for w in words]).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, words) in enumerate(groups.items())])
    best = F.array_max(scores)
    return F.when(best["n"] > 0, best["name"]).otherwise(F.lit(default))


def sections(c: Column, markers: list[str]) -> Column:
    """Lines grouped into sections: a line that holds a marker opens one, lines before the first belong to none.
    Array of (section_id, content, word_count)."""
    lines = F.split(c, "\n")
    start = F.array().cast("array<struct<section_id:string,content:string>>")

    def step(acc: Column, line: Column) -> Column:
        low = F.lower(line)
        opens = reduce(lambda a, b: a | b, [low.contains(m) for m in markers])
        new = F.concat(acc, F.array(F.struct(F.trim(line).alias("section_id"), F.lit("").alias("content"))))
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["section_id"].alias("section_id"), F.concat(last["content"], line, F.lit("\n")).alias("content"))))
        return F.when(opens, new).when(F.size(acc) > 0, grown).otherwise(acc)

    return F.transform(F.aggregate(lines, start, step), lambda s: F.struct(s["section_id"], s["content"], word_count(s["content"]).alias("word_count")))


def section_sizes(c: Column, markers: list[str]) -> Column:
    """Number, lines and characters of the sections that lines with a marker open, within the row."""
    def sized(z: Column) -> Column:
        lines, starts = z["lines"], z["starts"]

        def one(s: Column, k: Column) -> Column:
            n = F.coalesce(F.get(starts, k + 1), F.size(lines)) - s
            return F.struct((k + 1).cast("long").alias("section"), n.cast("long").alias("n_lines"), F.aggregate(F.slice(lines, s + 1, n), F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"))

        return F.transform(starts, one)

    def opened(lines: Column) -> Column:
        opens = lambda i: reduce(lambda a, b: a | b, [F.lower(F.get(lines, i)).contains(m) for m in markers])
        return F.struct(lines.alias("lines"), F.filter(F.sequence(F.lit(0), F.size(lines) - 1), opens).alias("starts"))

    return F.get(F.transform(F.transform(F.array(F.split(c, "\n")), opened), sized), 0)


def date_sentences(c: Column, limit: int = 20) -> Column:
    """Sentences with a year, and the first and last two: one of each, the first ``limit`` by place."""
    parts = F.split(c, "[.!?]", -1)
    n = F.size(parts)
    kept = F.filter(parts, lambda s, i: (F.trim(s) != "") & (s.rlike("[0-9]{4}") | (i < 2) | (i >= n - 2)))
    return F.slice(F.array_distinct(F.transform(kept, lambda s: F.trim(s))), 1, limit)


def micros(c: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (UTC)."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))
