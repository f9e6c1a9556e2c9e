"""Stores under upserts, daily metrics, tables out of replies."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from docketlake.functions import tables
from docketlake.operators import metrics
from docketlake.sources import changelog

SCHEMA = "id string, value int"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def held(spark, folder):
    return {r["id"]: r["value"] for r in changelog.current(spark, folder, "id", SCHEMA).collect()}


def test_latest_row_of_each_key(spark, tmp_path):
    folder = str(tmp_path)
    assert held(spark, folder) == {}
    changelog.append(rows(spark, ("a", 1), ("b", 1), ("c", 1)), folder, "id", 4)
    changelog.append(rows(spark, ("a", 2), ("d", 2), ("d", 1), ("e", None)), folder, "id", 4)
    changelog.remove(rows(spark, ("b", 0), ("zz", 0)), folder, "id", 4)
    want = {"a": 2, "c": 1, "d": 2, "e": None}
    assert held(spark, folder) == want
    changelog.compact(spark, folder, "id", SCHEMA, 4)
    assert held(spark, folder) == want and len(changelog.live_entries(folder)) == 1
    changelog.append(rows(spark, ("b", 5)), folder, "id", 4)
    changelog.compact(spark, folder, "id", SCHEMA, 4)
    assert held(spark, folder) == {**want, "b": 5} and len(changelog.live_entries(folder)) == 1


def test_writers_at_once_and_a_compaction_between(spark, tmp_path):
    folder = str(tmp_path)
    changelog.append(rows(spark, *[(f"k{i}", 0) for i in range(20)]), folder, "id", 4)
    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(changelog.append, rows(spark, (f"k{i}", i + 1), (f"n{i}", i)), folder, "id", 4) for i in range(6)]
        jobs.insert(3, pool.submit(changelog.compact, spark, folder, "id", SCHEMA, 4))
        numbers = [j.result() for j in jobs]
    assert len(set(numbers)) == 7
    assert held(spark, folder) == {f"k{i}": i + 1 if i < 6 else 0 for i in range(20)} | {f"n{i}": i for i in range(6)}
    changelog.compact(spark, folder, "id", SCHEMA, 4)
    assert len(held(spark, folder)) == 26


def test_metrics_merge_within_their_bounds(spark):
    r = random.Random(2)
    data = [(f"a{i % 3}", i % 9, r.expovariate(0.1) if i % 50 else None, r.random() > 0.3, r.choice(["timeout"] * 6 + ["parse"] * 3 + ["http"] + [f"rare{i}"])) for i in range(60_000)]
    runs = spark.createDataFrame(data, "agent string, day int, seconds double, success boolean, error string")
    days = metrics.daily_metrics(runs, "agent", "day").persist()
    for some, keep in (("day < 4", lambda x: x[1] < 4), ("agent = 'a1'", lambda x: x[0] == "a1"), ("true", lambda x: True)):
        got = metrics.report(metrics.merged(days.where(some))).first()
        held_rows = [x for x in data if keep(x)]
        times = sorted(x[2] for x in held_rows if x[2] is not None)
        assert got["n"] == len(held_rows) and got["least"] == times[0] and got["greatest"] == times[-1]
        assert got["mean"] == pytest.approx(sum(times) / len(times), abs=1e-5) and got["success_rate"] == pytest.approx(sum(x[3] for x in held_rows) / len(held_rows), abs=1e-6)
        for q, at in ((got["median"], 0.5), (got["p95"], 0.95)):
            assert abs(sum(t <= q for t in times) / len(times) - at) <= 0.002
        assert [e["item"] for e in got["common_errors"]][:2] == ["timeout", "parse"]
    exact = metrics.report(metrics.merged(days.where("day = 1 AND agent = 'a1'"))).first()
    few = metrics.report(metrics.daily_metrics(runs.limit(101).where("seconds IS NOT NULL"), F.lit(1).alias("g"))).first()
    times = sorted(x[2] for x in data[:101] if x[2] is not None)
    assert few["median"] == times[(len(times) + 1) // 2 - 1] and exact["n"] > 0
    none = metrics.report(metrics.daily_metrics(spark.createDataFrame([(None, None, None)], "seconds double, success boolean, error string"), F.lit(1).alias("g"))).first()
    assert none["n"] == 1 and none["success_rate"] == 0 and none["median"] is None and none["common_errors"] == []
    days.unpersist()


def test_tables_out_of_replies(spark):
    tables.register(spark)
    replies = [
        (1, 'Here: ```json\n[{"source_name": "A", "source_url": "https://a", "source_type": "rss_feed", "confidence": 0.9}, {"source_name": "B", "source_url": "https://b", "source_type": "odd", "update_frequency": "never"}, {"source_name": "no url"}]\n```'),
        (2, '{"discovered_sources": [{"source_name": "C", "source_url": "https://c", "content_types": ["alerts"], "feed_format": "rss"}]}'), (3, "no array"), (4, None), (5, "[1, 2"), (6, "[]"),
    ]
    spark.createDataFrame(replies, "site int, reply string").createOrReplaceTempView("replies")
    got = spark.sql("SELECT site, t.* FROM replies, LATERAL reply_rows(reply, 'sources') t ORDER BY name").collect()
    assert [(r["site"], r["name"], r["source_type"], r["update_frequency"], r["confidence"], r["content_types"], r["feed_url"], r["feed_format"]) for r in got] == [
        (1, "A", "rss_feed", "daily", 0.9, ["regulations"], "https://a", None), (1, "B", "daily_listing", "daily", 0.7, ["regulations"], None, None), (2, "C", "daily_listing", "daily", 0.7, ["alerts"], None, "rss")]
    assert got[0]["source_id"] == __import__("hashlib").md5(b"A_https://a").hexdigest()[:12]
    portals = spark.sql("""SELECT * FROM reply_rows('[{"name": "P", "url": "u", "jurisdiction": "US", "publication_types": ["gazettes"]}]', 'portals')""")
    assert portals.columns == list(tables.KINDS["portals"]) and tuple(portals.first()) == ("P", "u", "US", None, ["gazettes"], None, None)
    with pytest.raises(Exception, match="kind must be"):
        spark.sql("SELECT * FROM reply_rows('[]', 'other')").collect()
