"""Operators over small tables with known answers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from docketlake.functions import model
from docketlake.functions import text as X
from docketlake.operators import changes, documents, learning, monitoring, sinks, workflow
from docketlake.sources import feeds, html, tables
from docketlake.streaming import messages

NOW = dt.datetime(2024, 5, 10, 12)


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_feeds(spark):
    rss = "<rss><channel><item><title>A</title><link>http://a</link><description>d</description><pubDate>Mon, 06 May 2024 10:00:00 +0000</pubDate></item><item><title>no link</title></item></channel></rss>"
    atom = '<feed><entry><title>B</title><link href="http://b"/><summary>s</summary><updated>2024-05-07T00:00:00Z</updated></entry></feed>'
    rows = [("f", "r", "application/rss+xml", rss), ("f", "a", "application/xml", atom), ("f", "j", "application/json", json.dumps({"items": [{"title": "", "name": "C", "html_url": "http://c", "date": "bad"}]})), ("f", "l", "application/json", json.dumps([{"title": "D", "url": "http://d"}])), ("f", "x", "text/xml", "<rss><broken")]
    got = feeds.feed_items(spark.createDataFrame(rows, "url string, source_id string, content_type string, body string"))
    assert values(got, "source_id", "title", "url") == [("a", "B", "http://b"), ("j", "C", "http://c"), ("l", "D", "http://d"), ("r", "A", "http://a")]
    dates = {r["source_id"]: r["published_date"] for r in got.collect()}
    assert dates["r"] == dt.datetime(2024, 5, 6, 10) and dates["j"] is None


def test_robots(spark):
    rules = feeds.robots_rules(F.lit("User-agent: *\nDisallow: /a\nAllow: /a/b\n"))
    got = spark.range(1).select(*[feeds.robots_allowed(rules, F.lit(p)).alias(p) for p in ("/a/x", "/a/b/c", "/z")]).first()
    assert tuple(got) == (False, True, True)


PAGE = """<html lang="en-GB"><head><title>T</title><meta name="k" content="v"></head><body><nav><a href="/n">N</a></nav><main><h1>Head</h1><p>one<p>two <b>bold
<table><tr><th>h<td>1</table><ol><li>x<li>y</ol><dl><dt>t<dd>d</dl><a href="d.pdf">doc</a><h3>Sub</h3><script>var a="</p>";</script></main><img src=a alt=b><img src=c></body>"""


def test_page_record(spark):
    r = html.parse_page(PAGE)
    assert r["headings"] == [{"level": 1, "text": "Head"}, {"level": 3, "text": "Sub"}] and r["paragraphs"][0] == "one" and r["items"] == ["x", "y"]
    assert r["terms"] == [{"term": "t", "text": "d"}] and r["tables"] == [[["h", "1"]]] and r["meta"] == {"k": "v"} and (r["images"], r["images_with_alt"]) == (2, 1)
    assert "var a" not in r["main_text"] and r["main_text"].startswith("Head one two bold")
    p = F.col("page")
    got = html.parsed(spark.createDataFrame([(1, PAGE), (2, None)], "id int, html string")).select("id", html.title(p), html.language(p), html.headings_in_order(p), F.size(html.document_links(p)), html.tag(p, "h1", "h3"))
    assert sorted(map(tuple, got.collect())) == [(1, "Head", "en", True, 1, 2), (2, "No title found", "en", False, 0, 0)]


def test_knowledge_base(spark, tmp_path):
    pattern = {"pattern_id": "p", "pattern_type": "css", "pattern_value": ".x", "success_count": 3, "failure_count": 1, "confidence_score": 0.75}
    (tmp_path / "k.json").write_text(json.dumps({"UK": {"jurisdiction_name": "UK", "source_profiles": {"s": {"source_id": "s", "extraction_patterns": {"p": pattern}}}}}))
    assert values(tables.patterns_of(tables.knowledge_base(spark, str(tmp_path / "k.json"))), "jurisdiction", "source_id", "pattern_id", "confidence_score") == [("UK", "s", "p", 0.75)]


def test_listing_and_choice(spark):
    s = spark.createDataFrame([(1, "a", "UK", "FSA", True, 0.5, NOW), (2, "b", "UK", "HSE", False, 0.25, None), (3, "c", "US", "FDA", True, 1.0, None)], "source_id int, name string, jurisdiction string, agency string, is_active boolean, confidence double, last_checked timestamp")
    assert values(monitoring.source_listing(s, jurisdiction="UK"), "source_id", "confidence", "last_checked") == [(1, "0.50", "2024-05-10 12:00"), (2, "0.25", "Never")]
    assert values(monitoring.selected_sources(s, ids=[2]), "source_id") == [(2,)]
    assert values(monitoring.selected_sources(s, jurisdictions=["UK"]), "source_id") == [(1,)] and values(monitoring.selected_sources(s), "source_id") == [(1,), (3,)]
    assert values(s.where(monitoring.agency_match(F.col("agency"), ["fs", "fd"])), "source_id") == [(1,), (3,)]


def test_items(spark):
    d = lambda n: NOW - dt.timedelta(days=n)
    rows = [(1, "u", d(0), d(9), "rule", 0.3), (2, "u", d(9), d(0), "news", 0.9), (3, "v", d(9), None, "rule", 0.9), (4, "w", d(0), None, "rule", 0.29)]
    items = spark.createDataFrame(rows, "item_id int, url string, discovered_date timestamp, published_date timestamp, item_type string, relevance_score double").withColumn("content_snippet", F.lit("x" * 300))
    got = monitoring.day_items(items, NOW.date()).collect()
    assert [(r["item_id"], len(r["content_snippet"])) for r in got] == [(2, 200), (1, 200)]
    assert [r["item_id"] for r in monitoring.day_items(items, NOW.date(), types=["rule"]).collect()] == [1]
    assert values(monitoring.unseen(items, items.where("url = 'v'")), "item_id") == [(1,), (4,)]
    assert values(monitoring.since(items, "discovered_date", NOW, 9), "item_id") == [(1,), (2,), (3,), (4,)]
    assert values(monitoring.since(items, "discovered_date", NOW, 9, strict=True), "item_id") == [(1,), (4,)]
    assert values(sinks.retained(items, "discovered_date", NOW, 9), "item_id") == [(1,), (4,)]


def test_zero_fill_and_last(spark):
    t = spark.createDataFrame([("a", 1), ("a", 2), ("z", 3), (None, 4)], "k string, n int")
    assert values(monitoring.zero_filled(t, "k", ["a", "b"]), "k", "n") == [("a", 2), ("b", 0), ("unknown", 1), ("z", 1)]
    assert values(monitoring.last_n(t.where("k = 'a'"), "k", ["n"], 1), "n") == [(2,)]


def test_learning(spark):
    e = spark.createDataFrame([("p", 1, True, 12.0, 5.0), ("p", 2, False, 0.0, 0.0), ("q", 1, True, 1.0, 20.0)], "k string, at int, success boolean, items double, seconds double")
    got = {r["k"]: r["confidence"] for r in learning.reinforced(e, "k", ["at"]).collect()}
    assert got == {"p": 0.5, "q": 1.0}
    assert values(learning.use_totals(e, "k"), "k", "success_count", "failure_count", "confidence") == [("p", 1, 1, 0.5), ("q", 1, 0, 1.0)]
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"), spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int")
    assert values(learning.upsert(old, new, "id"), "id", "v") == [("a", 1), ("b", 3), ("c", 4)]
    assert values(learning.insert_absent(old, new, "id"), "id", "v") == [("a", 1), ("b", 2), ("c", 4)]
    rec = learning.recommendations(spark.createDataFrame([(1, 3, 0.9, 0), (2, 9, 0.5, 1)], "source_id int, sessions int, success_rate double, weak_patterns int"))
    assert values(rec, "source_id", "action") == [(1, "data_collection"), (2, "opportunity"), (2, "optimisation")]


def test_failures_weigh_from_five_on(spark):
    e = spark.createDataFrame([("p", i, i == 0, 0.0, 0.0) for i in range(5)], "k string, at int, success boolean, items double, seconds double")
    assert learning.reinforced(e, "k", ["at"]).first()["confidence"] == pytest.approx(0.2 - 0.08)


def test_changes(spark):
    s = spark.createDataFrame([("t", 1, "a"), ("t", 2, "a"), ("t", 3, "b"), ("t", 4, "a"), ("u", 1, None)], "target string, at int, content string")
    assert [r["change"] for r in changes.change_status(s, "target", "at", "content").orderBy("target", "at").collect()] == ["baseline", "unchanged", "modified", "modified", "baseline"]
    assert "+b" in changes.changes(s, "target", "at", "content").orderBy("at").first()["diff"]
    got = spark.range(1).select(changes.significance(F.lit('```{"significance": 0.8}```')).alias("a"), changes.significance(F.lit(None).cast("string")).alias("b")).first()
    assert tuple(got["a"]) == (0.8, "medium") and tuple(got["b"]) == (0.5, "unknown")


def test_workflow(spark):
    steps = spark.createDataFrame([("w", 1, "completed", []), ("w", 2, "pending", [1]), ("w", 3, "pending", [1]), ("w", 4, "pending", [2, 3]), ("v", 1, "pending", [])], "workflow_id string, step_id int, status string, dependencies array<int>")
    assert values(workflow.ready(steps), "workflow_id", "step_id") == [("v", 1), ("w", 2), ("w", 3)]
    assert values(workflow.progress(steps), "workflow_id", "progress", "final_status") == [("v", 0.0, "running"), ("w", 0.25, "running")]
    r = workflow.retries(spark.createDataFrame([(1, "running", 0, 2), (2, "running", 1, 2), (3, "running", 0, 2)], "step_id int, status string, retry_count int, max_retries int"), spark.createDataFrame([(1,), (2,)], "step_id int"))
    assert values(r, "step_id", "status", "retry_count") == [(1, "pending", 1), (2, "failed", 2), (3, "running", 0)]
    a = spark.createDataFrame([("x", "html", "idle", 2, 0), ("y", "html", "idle", 1, 5), ("z", "html", "busy", 0, 0)], "agent_id string, role string, status string, queue_length int, error_count int")
    assert values(workflow.available(a, spark.createDataFrame([(1, "html"), (2, "pdf")], "task_id int, role string")), "task_id", "agent_id") == [(1, "y")]


def test_queues(spark):
    m = spark.createDataFrame([(1, "job_created", None, 1), (2, "job_failed", None, 2), (3, "odd", None, 3), (4, "odd", "validation", 4)], "message_id int, type string, recipient string, ts int").withColumn("queue", workflow.route(F.col("type"), F.col("recipient"), ["validation"]))
    assert values(workflow.dispatch(m, 1), "message_id", "outcome") == [(1, "queued"), (2, "queue_full"), (3, "no_route"), (4, "queued")]
    assert values(workflow.utilisation(m, {"orchestrator": 2, "idle": 5}), "queue", "n", "alert") == [("idle", 0, False), ("orchestrator", 2, True)]
    beats = spark.createDataFrame([("a", NOW), ("b", NOW - dt.timedelta(minutes=6)), ("c", None)], "agent_id string, ts timestamp")
    assert values(workflow.offline(beats, NOW), "agent_id", "offline") == [("a", False), ("b", True), ("c", False)]
    assert values(workflow.live(beats, NOW, F.lit(360)), "agent_id") == [("a",), ("b",)]
    stats = workflow.last_hundred(spark.createDataFrame([("k", i, float(i)) for i in range(1, 201)], "k string, at int, value double"), "k", ["at"]).first()
    assert (stats["n"], stats["mean"], stats["p95"]) == (100, 150.5, 195.95)
    assert tuple(spark.range(1).select(workflow.glob(F.lit("llm:a.b"), "llm:*"), workflow.glob(F.lit("llmx"), "llm?y")).first()) == (True, False)


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    path = sinks.rewrite(t, str(tmp_path / "s"), "1")
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception, match="exists"):
        sinks.rewrite(t, str(tmp_path / "s"), "1")
    assert values(sinks.without(t, "v", "a"), "id") == [(2,)]
    assert values(sinks.orphans(t, spark.createDataFrame([(1,)], "k int"), "id", "k"), "id") == [(2,)]
    assert values(sinks.cascade(t, spark.createDataFrame([(1,)], "k int"), "id", "k"), "id") == [(2,)]
    sinks.export_csv(t, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_messages(spark, tmp_path):
    rows = [(f"m{i}", ["job_created", "odd"][i % 2], "s", None, "{}", "c", NOW + dt.timedelta(minutes=i), 60) for i in range(20)]
    rows += rows[:3]
    spark.createDataFrame(rows, messages.SCHEMA).coalesce(2).write.parquet(str(tmp_path / "in"))
    stream = messages.routed(messages.read(spark, str(tmp_path / "in")), ["validation"])
    assert messages.write(stream, str(tmp_path / "q"), str(tmp_path / "dead"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "q")).count() == 12 and spark.read.parquet(str(tmp_path / "dead")).count() == 11
    batch = messages.from_json(messages.to_json(spark.createDataFrame(rows[:1], messages.SCHEMA)))
    assert batch.first()["id"] == "m0"
    query = messages.counters(stream, window="10 minutes").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 23
    once = messages.deduplicated(messages.read(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    once.awaitTermination(120)
    assert spark.table("once").count() == 20


def test_micros(spark):
    assert spark.range(1).select(X.micros(F.lit("1970-01-01 00:00:01"))).first()[0] == 1_000_000


def test_replies(spark):
    good, bare, none = '```json\n{"category": "food", "confidence": 0.9, "impact": "high",}\n```', "{category: 'odd', impact: 'low'}", "no object"
    got = [tuple(r["c"]) for r in spark.createDataFrame([(0, good), (1, bare), (2, none), (3, None)], "i int, t string").select("i", model.classification(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [("food", 0.9, "high"), ("not_product_compliance", 0.5, "low"), ("not_product_compliance", 0.5, "informational"), ("not_product_compliance", 0.5, "informational")]
    reply = spark.range(1).select(model.rule_scorer(F.lit("Recall: food ban, immediate"))).first()[0]
    assert json.loads(reply) == {"category": "food", "confidence": 0.8, "impact": "critical"}


def test_documents(spark):
    i = spark.range(1).select(documents.identity(F.lit("Act No. 12/2020"), F.lit("enacted 5 May 2020"), F.lit("https://a.gov/x")).alias("i")).first()["i"]
    assert tuple(i) == ("12/2020", "5 May 2020", "us", "act", "enacted")
    lacks = documents.issues(F.lit(10), F.lit(0), F.lit(5), F.lit(True), F.lit(False), F.lit(True))
    assert spark.range(1).select(documents.advice(lacks)).first()[0] == ["follow links", "extract structure again", "look up metadata"]
    assert spark.range(1).select(documents.plan_minutes(F.array(F.lit("pdf_extraction"), F.lit("odd")))).first()[0] == 11
    assert spark.range(1).select(documents.document_estimate(F.lit(3), F.lit(7), F.lit(0))).first()[0] == 9
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "url string, next_url string")
    assert values(documents.follow_pages(links, links.where("url = 'a'").select("url")), "url", "n") == [("a", 1), ("b", 2), ("c", 3)]
    words = spark.createDataFrame([("i", 1, 2, "b", 90), ("i", 1, 1, "a", 80), ("i", 1, 3, " ", 99), ("i", 2, 1, "z", 0)], "image string, line_num int, word_num int, text string, conf int")
    assert values(documents.ocr_lines(words), "line", "confidence") == [("a b", 85.0)]
