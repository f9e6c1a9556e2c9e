"""Weighted scores and tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlake.functions.text import total


def tier(c: Column, steps: list[tuple[float, object]], default) -> Column:
    """The value of the first step that ``c`` reaches."""
    out = None
    for least, value in steps:
        out = F.when(c >= least, value) if out is None else out.when(c >= least, value)
    return out.otherwise(default)


def above(c: Column, steps: list[tuple[float, float]], default: float = 0.0) -> Column:
    """As tier, but ``c`` must exceed the step."""
    out = None
    for more, value in steps:
        out = F.when(c > more, value) if out is None else out.when(c > more, value)
    return out.otherwise(default)


def points(*conditions: tuple[Column, float], cap: float | None = 1.0) -> Column:
    """Sum of the points of the conditions that hold; null counts as false."""
    s = total([F.when(c, F.lit(float(p))).otherwise(0.0) for c, p in conditions])
    return s if cap is None else F.least(F.lit(float(cap)), s)


def quality_tier(c: Column) -> Column:
    return tier(c, [(0.9, "excellent"), (0.7, "good"), (0.5, "fair"), (0.3, "poor")], "unacceptable")


def confidence_level(c: Column) -> Column:
    return tier(c, [(0.9, "very_high"), (0.7, "high"), (0.5, "medium"), (0.3, "low")], "very_low")


def level_score(c: Column) -> Column:
    """Confidence of a named level; 0 for others."""
    return F.when(c == "very_high", 0.95).when(c == "high", 0.85).when(c == "medium", 0.70).when(c == "low", 0.50).otherwise(0.0)


def level_tier(c: Column) -> Column:
    return tier(c, [(0.8, "high"), (0.5, "medium")], "low")


def content_quality(n_words: Column, structure: Column, legal_terms: Column, metadata: Column) -> Column:
    """Words tier + .25 structure + .25 of ten legal terms + .2 of three metadata fields."""
    words = above(n_words, [(1000, 0.3), (500, 0.2), (100, 0.1)])
    return words + 0.25 * structure + 0.25 * F.least(legal_terms / 10.0, F.lit(1.0)) + 0.2 * F.least(metadata / 3.0, F.lit(1.0))


def completeness(n_chars: Column, n_sections: Column, n_metadata: Column, has_authority: Column, known_type: Column) -> Column:
    """Content, sections, metadata, authority and type, at most 1."""
    s = above(n_chars, [(1000, 0.3), (500, 0.2)]) + F.when(n_sections > 0, 0.25).otherwise(0.0) + above(n_metadata, [(5, 0.2), (3, 0.15)])
    return F.least(F.lit(1.0), s + F.when(has_authority, 0.15).otherwise(0.0) + F.when(known_type, 0.1).otherwise(0.0))


def coverage_score(coverage: Column, n_missing: Column, n_total: Column) -> Column:
    """1 less what is missing, at least 0."""
    s = F.lit(1.0) - F.when(coverage == 0, 0.5).when(coverage < 0.3, 0.3).when(coverage < 0.7, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), s - F.least(F.lit(0.2), 0.05 * n_missing) - F.when(n_total < 1000, 0.2).otherwise(0.0))


def issues_score(n_issues: Column, each: float = 0.1) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - each * n_issues)


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def percent(a: Column, b: Column) -> Column:
    return ratio(100.0 * a, b)


def stage_action(quality: Column, n_errors: Column, routed: Column) -> Column:
    """complete ▸ retry ▸ fail ▸ hand over by job status."""
    return F.when((quality >= 0.8) & (n_errors == 0), "complete").when((quality < 0.5) & (n_errors < 3), "retry").when(n_errors >= 3, "fail").otherwise(F.concat(F.lit("handoff_"), routed))


def running_confidence(confidence: Column, n: Column) -> Column:
    """.8 and a fifth of the doubt, less .05 for each above three; within .3 and .95."""
    s = 0.8 + (1 - confidence) * 0.2 - F.greatest(F.lit(0.0), (n - 3) * 0.05)
    return F.least(F.lit(0.95), F.greatest(F.lit(0.3), s))
