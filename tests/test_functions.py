"""Column builders on small rows with values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docketlake import dictionaries as D
from docketlake.functions import scoring as S
from docketlake.functions import text as X
from docketlake.functions import urls as U
from docketlake.functions import validate as V


def one(spark, column, **values):
    """The column's value over one row of strings or numbers."""
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("action by act", 2), ("", 0), ("ACT", 1), (None, 0)])
def test_substrings_count_inside_words(spark, text, want):
    assert one(spark, X.keyword_total(X.text(F.lit(text).cast("string")), ["act"])) == want


def test_whole_words_only(spark):
    assert one(spark, X.word_total(F.lit("action act"), ["act"])) == 1


def test_no_overlap(spark):
    assert one(spark, X.substring_count(F.lit("aaaa"), "aa")) == 2


@pytest.mark.parametrize(("text", "want"), [("", 0), ("  ", 0), ("one", 1), (" a  b\nc ", 3)])
def test_word_count(spark, text, want):
    assert one(spark, X.word_count(F.lit(text))) == want


def test_patterns(spark):
    t = F.lit("On 2024-01-05 and 5/6/2024. Section 12. SI-2021-33, 42 U.S.C. § 1983, v1.2")
    assert one(spark, X.regex_total(t, D.DATE_PATTERNS)) == 2
    assert one(spark, X.regex_total(t, D.CITATION_PATTERNS)) == 2
    assert one(spark, X.regex_total(t, D.VERSION_PATTERNS)) == 1


def test_sections(spark):
    got = one(spark, X.sections(F.lit("intro\nSection 1\nfoo bar\nbaz\nArticle 2\n"), D.SECTION_MARKERS))
    assert [(s["section_id"], s["word_count"]) for s in got] == [("Section 1", 3), ("Article 2", 0)]


def test_best_label_ties(spark):
    assert one(spark, X.best_label(F.lit("law act"), D.DOCUMENT_TYPES)) == "legislation"
    assert one(spark, X.best_label(F.lit("none"), D.DOCUMENT_TYPES, "other")) == "other"


def test_first_filled(spark):
    assert one(spark, X.first_filled(F.lit(""), F.lit(None).cast("string"), F.lit("b"))) == "b"


@pytest.mark.parametrize(("score", "quality", "level"), [(0.9, "excellent", "very_high"), (0.8999, "good", "high"), (0.5, "fair", "medium"), (0.3, "poor", "low"), (0.0, "unacceptable", "very_low")])
def test_tiers(spark, score, quality, level):
    assert one(spark, S.quality_tier(F.lit(score))) == quality and one(spark, S.confidence_level(F.lit(score))) == level


def test_scores(spark):
    assert one(spark, S.points((F.lit(True), 0.8), (F.lit(None).cast("boolean"), 0.5), (F.lit(True), 0.4))) == 1.0
    assert one(spark, S.percent(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, F.round(S.running_confidence(F.lit(0.5), F.lit(5)), 6)) == 0.8
    assert one(spark, S.stage_action(F.lit(0.4), F.lit(1), F.lit("x"))) == "retry"
    assert one(spark, S.stage_action(F.lit(0.6), F.lit(1), F.lit("x"))) == "handoff_x"
    assert one(spark, S.coverage_score(F.lit(0.0), F.lit(10), F.lit(10))) == pytest.approx(0.1)


@pytest.mark.parametrize(("text", "want"), [(None, "empty"), (" ", "empty"), ("short", "too short"), ("1234567890", "too few letters"), ("long enough", None)])
def test_content(spark, text, want):
    assert one(spark, V.content(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("url", "bad"), [("https://a.b/c", False), ("ftp://a.b", True), ("http://", True), (None, True), ("", True)])
def test_url(spark, url, bad):
    assert (one(spark, V.url(F.lit(url).cast("string"))) is not None) == bad


@pytest.mark.parametrize(("name", "low", "high"), [(n, *r) for n, r in V.RANGES.items()])
def test_ranges(spark, name, low, high):
    for value, ok in ((low, True), (high, True), (low - 1, False), (high + 1, False)):
        assert (one(spark, V.ranged(name, F.lit(value))) is None) == ok
    assert one(spark, V.ranged(name, F.lit(None).cast("int"), nullable=True)) is None


def test_other_validators(spark):
    assert one(spark, V.search_query(F.lit("x; drop  table y"))) == "dangerous query"
    assert one(spark, V.search_query(F.lit("food safety"))) is None
    assert one(spark, V.language(F.lit("EN "))) is None and one(spark, V.language(F.lit("english"))) is not None
    assert one(spark, V.known_language(F.lit("xx"))) is False
    day = lambda y: F.lit(dt.date(y, 1, 1))
    assert one(spark, V.date_range(day(2024), day(2023), day(2024))) == "start after end"
    assert one(spark, V.date_range(day(2024), day(2036), day(2024))) == "too far ahead"
    assert one(spark, V.identifiers(F.create_map(F.lit("primary_id"), F.lit("ab")))) == "primary_id length"
    assert one(spark, F.size(V.errors(V.keyword(F.lit("ab")), V.keyword(F.lit("abc"))))) == 1


def test_addresses(spark):
    u = F.lit("https://www.Legislation.gov.uk:443/a/b.html?x=1#f")
    assert one(spark, U.host(u)) == "www.legislation.gov.uk" and one(spark, U.path(u)) == "/a/b.html" and one(spark, U.query_of(u)) == "x=1"
    assert one(spark, U.jurisdiction(u)) == "uk" and one(spark, U.jurisdiction(F.lit("https://x.gov.au/"))) == "australia"
    for link, want in {"c": "https://h.org/a/c", "/c": "https://h.org/c", "//k.org/": "https://k.org/", "http://z.org": "http://z.org", "#p": "https://h.org/a/b?q#p"}.items():
        assert one(spark, U.resolve(F.lit("https://h.org/a/b?q"), F.lit(link))) == want
    assert one(spark, U.link_type(F.lit("/x.PDF"))) == "pdf" and one(spark, U.link_type(F.lit("/news"))) == "general"
