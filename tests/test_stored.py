"""Stored collections come back whole; records, targets and pages that follow one another."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docketlake import dictionaries as D
from docketlake.functions import pages
from docketlake.operators import cache, documents, records
from docketlake.sources import stores

AT = "2024-01-02T03:04:05.678901"
ENTITIES = {
    "publication_sources": {"source_id": "a", "name": "n", "url": "https://x.org", "source_type": "api_endpoint", "jurisdiction": "EU", "agency": "CPSC", "discovered_date": AT, "discovery_method": "automated_scan", "confidence_score": 0.9, "update_frequency": "real_time", "content_types": ["regulations", "alerts"], "feed_url": None, "feed_format": "json_api", "is_active": True, "last_checked": None, "check_interval_hours": 24, "publication_date_selectors": [".date"], "title_selectors": [], "content_link_patterns": ["a[href]"], "publications_found": 3, "false_positive_rate": 0.25, "extraction_success_rate": 0.0},
    "discovery_sessions": {"session_id": "s", "start_time": AT, "target_jurisdictions": ["US", "UK"], "discovery_methods": ["scan"], "sources_discovered": ["a"], "total_urls_scanned": 7, "successful_discoveries": 1, "session_notes": []},
    "feed_items": {"item_id": "i", "source_id": "a", "title": "t é", "url": "u", "content_snippet": "c", "published_date": None, "discovered_date": AT, "item_type": "alert", "keywords": ["k"], "status": "filtered_out", "extracted_content": None, "analysis_results": {"a": [1, {"b": None}]}, "relevance_score": 0.5, "content_quality_score": 0.0, "business_impact_score": 1.0},
    "monitoring_sessions": {"session_id": "m", "start_time": AT, "sources_checked": 1, "feeds_processed": 2, "items_discovered": 3, "new_items": 4, "errors_encountered": 0, "session_duration_seconds": 1.5, "session_notes": ["x"]},
    "monitoring_targets": {"id": "t", "name": "n", "url": "u", "website_type": "government_portal", "monitoring_frequency": "daily", "change_indicators": [".new"], "last_checked": AT, "last_content_hash": "h", "baseline_content": "line\nline", "change_detection_strategy": "content_hash"},
    "change_history": {"document_id": "d", "url": "u", "change_type": "modified", "change_date": AT, "previous_content_hash": None, "current_content_hash": "h", "diff_summary": "s", "change_details": {"n": 1}, "significance_score": 0.7, "affected_sections": ["1", "Annex"], "compliance_impact": "high"},
}


def same(name, field, got, want):
    if want is None:
        return got is None
    if field in ("analysis_results", "change_details"):
        return json.loads(got) == want
    return got == (datetime.fromisoformat(want) if want == AT else want)


@pytest.mark.parametrize("name", sorted(ENTITIES))
def test_every_field_comes_back(spark, tmp_path, name):
    record = ENTITIES[name]
    assert sorted(record) == sorted(f.name for f in stores.fields(name))
    (tmp_path / "x.json").write_text(json.dumps([record, {**record, "name": None}, {k: None for k in record}, {}], indent=2))
    rows = stores.store(spark, str(tmp_path / "x.json"), name).collect()
    assert len(rows) == 2 and rows[0]["unread"] == {}
    assert all(same(name, k, rows[0][k], v) for k, v in record.items())


def test_what_does_not_fit_is_kept(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"name": "no id", "source_type": "bulletin", "confidence_score": "high", "is_active": "perhaps", "discovered_date": "yesterday", "update_frequency": "DAILY", "check_interval_hours": 12.5}]))
    r = stores.store(spark, str(tmp_path / "s.json"), "publication_sources").first()
    assert r["name"] == "no id" and r["source_type"] is None and r["confidence_score"] is None
    assert r["unread"] == {"source_type": "bulletin", "confidence_score": "high", "is_active": "perhaps", "discovered_date": "yesterday", "update_frequency": "DAILY", "check_interval_hours": "12.5"}


def test_missing_and_malformed_files(spark, tmp_path):
    (tmp_path / "bad.json").write_text("[{")
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "seen.json").write_text('{"http://x": "1"}')
    for name in ("bad", "none", "empty"):
        rows = stores.store(spark, str(tmp_path / f"{name}.json"), "change_history")
        assert rows.count() == 0 and "unread" in rows.columns
    assert [tuple(x) for x in stores.seen_items(spark, str(tmp_path / "seen.json")).collect()] == [("http://x", "1")]


def test_targets(spark):
    for entries in (D.COMMON_TARGETS, D.PRODUCT_SAFETY_TARGETS, D.COMPREHENSIVE_TARGETS):
        rows = records.targets(spark, entries).collect()
        assert [(r["name"], r["url"], r["website_type"], r["monitoring_frequency"]) for r in rows] == entries and len({r["id"] for r in rows}) == len(entries)
    first = records.targets(spark).first()
    assert first["id"] == __import__("hashlib").md5(f"{first['name']}_{first['url']}".encode()).hexdigest()[:12] and first["change_indicators"] == []


def test_title_types(spark):
    titles = {"Regulation on activities": "regulation", "Bill of Directive": "bill", "An Act": "act", "directive x": "directive", "Notice": "other"}
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select("t", records.title_type(F.col("t"), F.lit(None).cast("string")).alias("k"), records.title_type(F.col("t"), F.lit("guidance")).alias("h"))
    assert {r["t"]: r["k"] for r in rows.collect()} == titles and {r["t"]: r["h"] for r in rows.collect()}["Notice"] == "guidance"


def test_numbers_and_citations(spark):
    numbers = {"Directive 2016/679": "2016/679", "SI 2020/12": "2020/12", "si  2020/7x": None, "no. 5 OF 2020": "no. 5 OF 2020", "2020 No. 5": None}
    rows = spark.createDataFrame([(t,) for t in numbers], "t string").select("t", records.identifiers(F.create_map().cast("map<string,string>"), F.col("t")).alias("m")).collect()
    assert {r["t"]: r["m"].get("primary_id") for r in rows} == numbers
    from docketlake.sources import html as H

    page = H.parsed(spark.createDataFrame([("u", "<body><p>See 15 u.s.c. § 2051, Pub. L. No. 110-314 and 2016/679/EU.</p></body>")], "url string, html string"))
    cited = page.select(pages.references(F.col("page"), F.col("url")).alias("r")).first()["r"]
    assert [x["text"] for x in cited] == ["15 u.s.c. § 2051", "Pub. L. No. 110-314", "2016/679/EU"]


def test_entries_live_by_kind():
    assert cache.TTL == {"llm_response": 86_400, "extracted_content": 7 * 86_400, "website_analysis": 86_400, "pdf_content": 30 * 86_400, "image_analysis": 7 * 86_400, "validation_result": 43_200, "workflow_state": 3_600}


@pytest.mark.parametrize("most", [1, 2, 3, 7, 10])
def test_pages_that_follow(spark, most):
    edges = {"a": "b", "b": "c", "c": "a", "d": "b", "e": None, "f": "f", **{f"p{i}": f"p{i + 1}" for i in range(30)}}
    links = spark.createDataFrame(list(edges.items()), "url string, next_url string")
    want = []
    for start in [*edges, "outside"]:
        at, seen = start, []
        while at is not None and at not in seen and len(seen) < most:
            seen.append(at)
            at = edges.get(at)
        want += [(start, p, i + 1) for i, p in enumerate(seen)]
    starts = spark.createDataFrame([(u,) for u in [*edges, "outside", "a", None]], "url string")
    assert sorted(tuple(r) for r in documents.follow_pages(links, starts, most).collect()) == sorted(want)


def test_many_starts_are_followed(spark):
    starts = spark.range(200_000).select(F.col("id").alias("url"))
    links = starts.select("url", F.when(F.col("url") % 1000 != 999, F.col("url") + 1).alias("next_url"))
    out = documents.follow_pages(links, starts, 10).agg(F.count("*").alias("n"), F.max("n").alias("most"), F.sum("url").alias("s")).first()
    assert out["n"] == 200 * (991 * 10 + 45) and out["most"] == 10
