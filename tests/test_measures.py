"""Pattern counts against Python's re, scores against plain sums, page features of small pages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docketlake import dictionaries as D
from docketlake.functions import assess as A
from docketlake.functions import jobs as J
from docketlake.functions import pages as P
from docketlake.functions import text as X
from docketlake.operators import cache, coordination, records, workflow
from docketlake.plans.catalogue import REGEX_MEASURES
from docketlake.sources import feeds
from docketlake.sources import html as H

SAMPLES = [
    "1. 2. 3. 4.5 6.7 section 5 Section 12 ARTICLE 3, Part IV part ix I. II. VI. é1. x1. 1. ", "42 U.S.C. § 1983 and 42 U.S.C.1983; 40 C.F.R. 52, 12 stat. 9, Act of 1999 act of 2001", "Pub. L. No. 117-58 pub.l.no. 3-4 S. 1234 H.R. 5 xS. 7",
    "SI-2021-1234 ab-1999-1 2021/123/EC 2021/1/ec No. 5 of 2020 no.7of1999 S.I. 2020/1 s.i.2020/2", "01/02/2021 2021-03-04 January 1, 2021 1 January 2021 é2021-01-02 5 März 2021", "version 2 v1.2 revision 3 updated 4 amended 5", "2021 USC 123 123 F. 3 456", "", "no digits at all. Section §",
]


@pytest.mark.parametrize("name", sorted(REGEX_MEASURES))
def test_patterns_count_as_pythons(spark, name):
    r = random.Random(name)
    pieces = " ".join(SAMPLES).split(" ") + ["\n", "é", "§", "I.", "1.", "2.3"]
    texts = SAMPLES + [" ".join(r.choice(pieces) for _ in range(60)) for _ in range(60)]
    patterns, ignore = REGEX_MEASURES[name]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.regex_total(F.col("t"), patterns, ignore).alias("n")).collect()
    assert {g["i"]: g["n"] for g in got} == {i: sum(len(re.findall(p, t, re.I if ignore else 0)) for p in patterns) for i, t in enumerate(texts)}


def value(spark, column, **cells):
    row = spark.range(1).select(*(c.alias(k) if not isinstance(c, (int, str, float, bool)) else F.lit(c).alias(k) for k, c in cells.items()) or [F.lit(1)])
    return row.select(column.alias("x")).first()["x"]


def test_broken_references(spark):
    t = "Section 5 applies. See Section 5 and refer to Article 9, pursuant to Clause x.y"
    refs = F.regexp_extract_all(F.col("t"), F.lit(X.engine_form(D.INTERNAL_REFERENCE, True)), F.lit(1))
    df = spark.createDataFrame([(t,), ("",)], "t string")
    assert [r["b"] for r in df.select(X.broken_references(F.col("t"), refs).alias("b")).collect()] == [["9", "x"], []]


def test_scores_of_nothing_and_of_all(spark):
    none, yes = F.lit(None).cast("boolean"), F.lit(True)
    few, many = F.lit(None).cast("int"), F.lit(1000)
    assert value(spark, A.record_completeness(none, few, none, none, none, few, few)) == 0
    assert value(spark, A.record_completeness(yes, many, yes, yes, yes, many, many)) == pytest.approx(1.0)
    assert value(spark, A.structure_clarity(yes, many, yes, yes, many)) == 1 and value(spark, A.structure_clarity(none, few, none, none, few)) == 0
    assert value(spark, A.content_completeness(yes, many, many, yes, yes)) == 1
    assert value(spark, A.metadata_quality(F.array(F.lit("DC.Author"), F.lit("date_published")))) == pytest.approx(2 / 9)
    assert value(spark, A.extraction_readiness(many, yes, yes, many, many)) == pytest.approx(1.0)
    assert value(spark, A.technical_complexity(F.lit(11), F.array(F.lit("vue"), F.lit("jquery")), yes)) == pytest.approx(0.9)
    assert value(spark, A.html_readiness(many, many, yes, many, many, yes)) == pytest.approx(1.0)
    assert value(spark, A.pdf_readiness(F.lit(1), F.lit(0))) == 0 and value(spark, A.pdf_readiness(F.lit(3), F.lit(4))) == 1
    assert value(spark, A.site_complexity(F.lit(10), F.lit(25_000), F.lit(10), few)) == pytest.approx(0.375)
    assert value(spark, A.feasibility(F.lit(1.0), F.lit(1.0), F.lit(0.0), yes, none, F.lit(1.0), F.lit(0))) == pytest.approx(1.0)
    assert value(spark, A.recommended_methods(F.lit(0.2), F.lit(0.0), F.lit(0.9), yes, none)) == ["html_parsing", "pdf_extraction", "computer_vision"]
    assert value(spark, A.structure_score(F.lit(30), none, none, F.lit(3))) == 0 and value(spark, A.structure_score(few, none, none, F.lit(0))) == 0
    assert value(spark, A.consistency_score(F.lit(1), F.lit(2))) == pytest.approx(0.6) and value(spark, A.coherence_score(F.lit(2), F.lit(0.1), F.lit(5))) == pytest.approx(0.7)
    assert value(spark, A.component_advice(F.array(F.lit("Bad FORMAT")), "citation")) == ["Standardize legal citation formats"]
    assert value(spark, A.component_advice(F.array().cast("array<string>"), "coherence")) == ["Improve semantic analysis of extracted content"]


def test_overall_quality_without_scores(spark):
    empty = F.array().cast("array<double>"), F.array().cast("array<string>")
    o = value(spark, A.overall_quality(*empty, F.array().cast("array<string>")))
    assert o["score"] == 0 and o["manual_review"] and o["confidence"] == "low"


def test_server_technology_and_cms(spark):
    headers = F.create_map(F.lit("server"), F.lit("nginx/1.2"), F.lit("cf-ray"), F.lit("x"))
    s = value(spark, A.server_technology(headers))
    assert (s["web_server"], s["cdn"], s["powered_by"]) == ("Nginx", True, None)
    assert value(spark, A.cms(F.lit("<link href=/wp-content/x> drupal"))) == "wordpress" and value(spark, A.cms(F.lit("plain"))) is None
    assert value(spark, A.libraries(F.array(F.lit("/js/jQuery.min.js"), F.lit("d3.js"), F.lit("x.js"), F.lit("jquery2.js")))) == ["d3.js", "jquery"]


def test_plans(spark):
    stages = J.stages_by_site(F.lit(True), F.lit(False), F.lit(None).cast("boolean"))
    assert value(spark, stages) == ["analysis", "html_extraction", "pdf_analysis", "validation"] and value(spark, J.plan_duration(stages, 5.0)) == 25
    assert value(spark, J.parallel_minutes(F.array(F.lit("html_parsing"), F.lit("unknown")))) == 5 and value(spark, J.parallel_minutes(F.array(F.lit("unknown")))) == 0
    assert value(spark, J.recovery(F.lit("html_error"), F.lit("extraction"), F.lit(0), F.lit(3)))["alternative"] == "pdf_extraction"
    assert value(spark, J.recovery(F.lit("timeout"), F.lit("extraction"), F.lit(3), F.lit(3)))["action"] == "reduce_scope"
    n = value(spark, J.next_stage(F.lit("failed"), F.lit(0), F.lit(3), F.lit(1), F.lit(3)))
    assert (n["stage"], n["retries"], n["archived"]) == (0, 2, False)
    assert value(spark, J.performance_advice(F.lit(0.5), F.lit(61), F.array(F.struct(F.lit("a").alias("agent"), F.lit(0.95).alias("utilisation")))))["health"] == "needs_improvement"


PAGE = """<html lang="en-GB"><head><title>T</title><meta name="description" content="d"><meta property="og:type" content="x"><link rel="canonical" href="/c"><link rel="preload stylesheet" href="/s">
<script type="application/ld+json">{}</script><script src="/react.js" async></script></head><body>
<nav class="Breadcrumb-nav"><ul><li class="menu-item"><a href="/a">Archive 1999</a></li><li><a href="http://x.org/b.pdf">B</a></li></ul></nav>
<div class="abstract"><p>Short abstract</p></div><section class="section one"><h2>First</h2><p>The first section has more than twenty characters, Section 12.</p></section>
<section class="section"><p>Second one without heading, 1 January 2020.</p><div class="references"><a href="ref.html">A ref</a></div></section>
<div class="appendix"><h3>Annex</h3>More</div><table><thead><tr><th>H</th></tr></thead><tbody><tr><td>v</td></tr></tbody></table><table><tr><td>x</td></tr></table>
<form class="search-box"><input type="search" name="query"><input type="checkbox"><select></select></form><form><textarea></textarea></form><div class="pagination"><a href="?p=2">2</a><a href="?p=n">Next</a></div>
<img src=x alt=y loading="lazy"><img src=z><div itemscope></div><footer>f <time>now</time></footer></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    return H.parsed(spark.createDataFrame([("http://h.org/d/", PAGE), ("http://h.org/", None), ("http://h.org/", "<p>broken <b>x"), ("http://h.org/", "")], "url string, html string")).persist()


def first(page, column):
    return page.select(column.alias("x")).collect()[0]["x"]


def test_page_parts(page):
    p, u = F.col("page"), F.col("url")
    s = first(page, P.sections(p))
    assert [x["title"] for x in s] == ["First", ""] and s[0]["content"].startswith("First The first section")
    assert first(page, P.abstract(p)) == "Short abstract"
    assert [x["title"] for x in first(page, P.appendices(p))] == ["Annex"]
    refs = first(page, P.references(p, u))
    assert [(x["type"], x["url"] or x["text"]) for x in refs] == [("reference", "http://h.org/d/ref.html")]
    assert first(page, P.dates(p)) == ["1 January 2020"]
    assert first(page, P.metadata(p, u)) == {"description": "d", "og:type": "x", "source_url": "http://h.org/d/"}
    flow = first(page, P.hierarchical_sections(p))
    assert [(x["title"], x["level"], len(x["content"])) for x in flow] == [("First", 2, 3), ("Annex", 3, 0)]
    t = first(page, P.tables(p))
    assert t[0]["headers"] == ["H"] and t[0]["rows"] == [["v"]]
    assert first(page, P.links(p, u, 1))[0]["url"] == "http://h.org/a"


def test_page_counts(page):
    p = F.col("page")
    n = first(page, P.navigation(p))
    assert (n["navs"], n["breadcrumbs"], n["pagination"], n["menu_items"], n["internal_links"]) == (1, True, True, 1, 4)
    f = first(page, P.forms(p))
    assert (f["forms"], f["search_forms"], f["inputs"], f["selects"], f["textareas"]) == (2, 1, 2, 1, 1)
    s = first(page, P.search_features(p))
    assert (s["search_inputs"], s["search_forms"], s["filter_options"], s["search_or_query_inputs"]) == (1, 1, 2, 2)
    d = first(page, P.data_tables(p))
    assert (d["total"], d["complex"], d["structured"]) == (2, 1, True)
    assert first(page, P.archive_links(p)) == 1 and first(page, P.pagination(p))["numbers"] == 1
    m = first(page, P.search_marks(p))
    assert m["title"] and m["description"] and m["canonical"] and not m["robots"]
    assert first(page, P.structured_data(p)) == ["json-ld", "microdata", "rdfa"]
    marks = first(page, P.loading_marks(p))
    assert marks["lazy"] and marks["preload"] == 1 and marks["async"] == 1
    assert first(page, P.accessibility(p))["alt_share"] == 0.5 and first(page, P.semantic_markup(p))
    assert first(page, P.script_dependency(p, F.col("html"))) and first(page, P.pdf_links(p)) == 1
    assert first(page, P.document_addresses(p, F.col("url")))["pdf"] == ["http://x.org/b.pdf"]
    assert first(page, P.headings_by_level(p)) == {"h2": ["First"], "h3": ["Annex"]}


def test_odd_pages_have_defined_features(page):
    p = F.col("page")
    columns = [P.sections(p), P.abstract(p), P.appendices(p), P.references(p, F.col("url")), P.navigation(p), P.forms(p), P.data_tables(p), P.search_marks(p), P.loading_marks(p), P.accessibility(p), P.hierarchy(p), P.layout(p), P.hierarchical_sections(p)]
    assert len(page.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).collect()) == 4


def test_html_feeds_give_their_links(spark):
    rows = spark.createDataFrame([("http://f.org/x/", "s", "text/html", '<a href="a.html">One</a><a href="b"></a>')], "url string, source_id string, content_type string, body string")
    assert [(r["title"], r["url"]) for r in feeds.feed_items(rows).collect()] == [("One", "http://f.org/x/a.html")]


def test_robots_lines_are_trimmed(spark):
    assert value(spark, feeds.robots_rules(F.lit("User-agent: *\n  Disallow: /a  \r\nAllow: /a/b")))[0]["path"] == "/a"


def test_cache_tables(spark):
    e = spark.createDataFrame([("llm:1", "llm", ["a"]), ("llm:2", "llm", None), ("pdf:1", "pdf", ["a", "b"]), (None, "pdf", [])], "key string, kind string, dependencies array<string>")
    assert cache.without_matches(e, "llm:?").count() == 2 and cache.without_matches(e, "*1", "pdf").count() == 3
    assert cache.without_dependents(e, "a").count() == 2 and cache.without_keys(e, e.where("key = 'llm:1'")).count() == 3
    assert cache.backoff() == [1.0, 2.0, 4.0]
    assert value(spark, cache.storage(F.lit(5000), F.lit(4600), 10_000, 1_000_000))["packed"] is False


def test_requeue_stops_at_the_first_failure(spark):
    dead = spark.createDataFrame([(i, i, "a" if i != 3 else "z") for i in range(6)], "message_id int, ts int, type string")
    queue = F.when(F.col("type") == "a", "q")
    assert sorted(r["message_id"] for r in coordination.requeued(dead, queue).collect()) == [0, 1, 2]
    assert coordination.requeued(dead.where("type = 'a'"), queue, 4).count() == 4
    left, gone = coordination.purged(spark.createDataFrame([("a",), ("b",), (None,)], "queue string"), "a")
    assert left.count() == 2 and gone.first()["purged"] == 1


def test_custom_steps(spark):
    rows = spark.createDataFrame([("w", '{"steps": [{"step_id": "a", "agent_role": "r"}, {"step_id": "b", "dependencies": ["a"], "priority": 1}]}'), ("x", "{bad")], "workflow_id string, config string")
    got = [(r["step_id"], r["dependencies"], r["priority"]) for r in coordination.custom_steps(rows).collect()]
    assert got == [("a", [], 5), ("b", ["a"], 1)]


def test_available_agent_is_the_best_of_its_role(spark):
    agents = spark.createDataFrame([("x", "r", "idle", 2, 0), ("y", "r", "idle", 1, 5), ("z", "r", "busy", 0, 0)], "agent_id string, role string, status string, queue_length int, error_count int")
    tasks = spark.createDataFrame([(1, "r"), (2, "r"), (3, "q")], "task_id int, role string")
    assert {r["task_id"]: r["agent_id"] for r in workflow.available(agents, tasks).collect()} == {1: "y", 2: "y"}


def test_records(spark):
    meta = F.create_map(F.lit("Doc_ID"), F.lit("7"), F.lit("publisher"), F.lit(""), F.lit("author"), F.lit("An"), F.lit("date_made"), F.lit("x"))
    assert value(spark, records.identifiers(meta, F.lit("The Order No. 5 of 2020"))) == {"Doc_ID": "7", "primary_id": "No. 5 of 2020"}
    a = value(spark, records.authority(meta, F.array(F.lit("Intro"), F.lit("Ministry of X"))))
    assert (a["name"], a["department"]) == ("An", "Ministry of X")
    assert value(spark, records.date_entries(meta, F.array(F.lit("a"))))["named"] == {"date_made": "x"}
    assert value(spark, records.trimmed_distinct(F.array(F.lit(" abc "), F.lit("abc"), F.lit("x")))) == ["abc"]
    assert value(spark, records.added(F.lit(None).cast("array<string>"), F.lit("f"))) == ["f"]
    sections = F.array(F.struct(F.lit("S").alias("title"), F.lit("c" * 300).alias("content")))
    assert value(spark, records.formatted(F.lit("T"), F.lit(""), sections)).startswith("Title: T\n\nSection: S\nccc")
    assert len(value(spark, records.outline(sections, F.array(F.lit(1))))["sections"][0]["summary"]) == 200
    assert value(spark, records.with_hints(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("3")))) == {"a": "2", "b": "3"}
    assert value(spark, records.with_error(F.lit(None).cast("array<string>"), F.lit("2024-01-02 03:04:05").cast("timestamp"), F.lit("m"))) == ["2024-01-02T03:04:05: m"]


def test_texts_lay_out(spark):
    x = value(spark, records.text_layout(F.lit("Name: Jo\n\n• one\n- two\na b c d\nkey:")))
    assert (x["table_rows"], x["fields"], x["items"]) == (1, 1, 2)


def test_settings():
    from docketlake.sources import stores

    text = "database:\n  host: h  # here\n  port: 99999\n  name: n\nredis:\n  host: r\nlist:\n  - a\n  - 2\nflag: true\n"
    for read in (stores.settings, stores.plain_settings):
        values = read(text)
        assert values["database"] == {"host": "h", "port": 99999, "name": "n"} and values["list"] == ["a", 2] and values["flag"] is True
        errors, warnings = stores.settings_report(values)
        assert errors == ["openai.api_key is required", "database.port must be between 1 and 65535"] and "redis.port is not set" in warnings
    assert stores.plain_settings(None) == {} == stores.plain_settings("- x") == stores.plain_settings("no colon")


def test_registry(spark):
    from docketlake.functions import registry as G

    tools = G.Registry()

    @tools.tool(x="int", y="int")
    def plus(x, y):
        """Adds."""
        return x + y

    assert [tuple(r) for r in tools.catalogue(spark).collect()] == [("plus", "Adds.", ["x int", "y int"])]
    call = lambda **a: value(spark, tools.call("plus", **a))
    assert call(x=F.lit("1"), y=F.lit(2))["result"] == "3" and call(x=F.lit("z"), y=F.lit(2))["error"] == "arguments of another type" and call(x=F.lit(1))["status"] == "error"
    assert value(spark, tools.call("none"))["error"] == "unknown tool none"
    reply = '{"choices": [{"message": {"content": "c", "tool_calls": [{"function": {"name": "plus", "arguments": "{}"}}]}}], "usage": {"total_tokens": 7}}'
    parts = value(spark, G.reply_parts(F.lit(reply)))
    assert (parts["content"], parts["tokens"], parts["calls"][0]["name"]) == ("c", 7, "plus") and value(spark, G.reply_parts(F.lit("x")))["calls"] == []
    assert [r["a"] for r in value(spark, G.listed_rows(F.lit('Here: [{"a": 1}, {"a": 2}] ok'), "struct<a:int>"))] == [1, 2] and value(spark, G.listed_rows(F.lit("none"), "struct<a:int>")) == []
    assert value(spark, G.chosen_ids(F.lit("- b\n1. a\nzz\nb"), F.array(F.lit("a"), F.lit("b")))) == ["b", "a"]
    assert value(spark, G.guarded(F.lit(1), F.array(F.lit("bad")))) is None


def test_profiles(spark, page):
    from docketlake.operators import profiles as W

    p, u = F.col("page"), F.col("url")
    assert first(page, W.next_page(p, u)) is None
    listing = H.parsed(spark.createDataFrame([("http://h.org/l/", '<a href="x">1</a><a href="?page=2">2</a>')], "url string, html string"))
    assert first(listing, W.next_page(p, u)).endswith("?page=2")
    assert first(page, W.matching_links(p, u, [r"\.pdf$", "nothing"])) == ["http://x.org/b.pdf"]
    r = first(page, W.regulation_record(p, u, F.lit("")))
    assert r["title"] == "T" and r["document_type"] == "other" and r["dates"]["extracted"] == ["1 January 2020"] and "unknown_authority" in r["issues"]
    s = first(page, W.structure_analysis(p))
    assert s["strategies"] == ["html_parsing", "table_extraction"] and s["clarity"] == pytest.approx(0.65)
    rows = spark.createDataFrame([("http://a.org/1", PAGE, {"server": "Apache"}), ("http://b.org/1", "", {})], "url string, html string, headers map<string,string>")
    made = W.profiles(rows).persist()
    assert {x["domain"]: x["profile"]["technical"]["server"]["web_server"] for x in made.collect()} == {"a.org": "Apache", "b.org": None}
    again = W.profiles(rows, made.where("domain = 'a.org'")).collect()
    assert len(again) == 2 and all(x["profile"] is not None for x in again)
