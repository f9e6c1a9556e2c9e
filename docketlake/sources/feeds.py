"""Items of fetched feeds (url, source_id, content_type, body): RSS, Atom, JSON; the links of other bodies, which are pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions.text import first_filled
from docketlake.functions.urls import resolve
from docketlake.sources.html import parsed
from docketlake.sources.tables import timestamp

RSS = "channel struct<item:array<struct<title:string,link:string,description:string,pubDate:string>>>"
ATOM = "entry array<struct<title:string,link:array<struct<_href:string>>,summary:string,updated:string>>"
ENTRY = "struct<title:string,name:string,url:string,link:string,html_url:string,description:string,abstract:string,summary:string,publication_date:string,published_date:string,date:string>"
ENVELOPES = ("items", "results", "documents")


def kind(content_type: Column, body: Column) -> Column:
    """Which reader a body goes to."""
    t = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(t.rlike("rss|xml|atom"), F.when(F.lower(body).contains("<feed"), "atom").otherwise("rss")).when(t.contains("json"), "json").otherwise("html")


def _items(rows: DataFrame, title: Column, url: Column, snippet: Column, date: Column) -> DataFrame:
    out = rows.select("source_id", F.col("url").alias("feed_url"), title.alias("title"), url.alias("url"), F.substring(F.coalesce(snippet, F.lit("")), 1, 500).alias("content_snippet"), timestamp(date).alias("published_date"), F.lit("unknown").alias("item_type"), F.lit(0.5).alias("relevance_score"))
    return out.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))


def feed_items(feeds: DataFrame) -> DataFrame:
    """Items with a title and an address. Malformed bodies give none; a date that can't be read is null."""
    marked = feeds.withColumn("_kind", kind(F.col("content_type"), F.col("body")))
    rss = marked.where("_kind = 'rss'").select("*", F.explode(F.from_xml("body", RSS, {"mode": "PERMISSIVE"})["channel"]["item"]).alias("i"))
    atom = marked.where("_kind = 'atom'").select("*", F.explode(F.from_xml("body", ATOM, {"mode": "PERMISSIVE"})["entry"]).alias("i"))
    lists = [F.from_json("body", f"struct<{e}:array<{ENTRY}>>")[e] for e in ENVELOPES]
    bare = F.when(F.ltrim("body").startswith("["), F.from_json("body", f"array<{ENTRY}>"))
    js = marked.where("_kind = 'json'").select("*", F.explode(F.coalesce(*lists, bare)).alias("i"))
    pages = parsed(marked.where("_kind = 'html'"), "body").select("*", F.explode("page.links").alias("i"))
    return (
        _items(pages, F.col("i.text"), resolve(F.col("url"), F.col("i.href")), F.lit(None).cast("string"), F.lit(None).cast("string"))
        .unionByName(_items(rss, F.col("i.title"), F.col("i.link"), F.col("i.description"), F.col("i.pubDate")))
        .unionByName(_items(atom, F.col("i.title"), F.get(F.col("i.link"), 0)["_href"], F.col("i.summary"), F.col("i.updated")))
        .unionByName(_items(js, first_filled(F.col("i.title"), F.col("i.name")), first_filled(F.col("i.url"), F.col("i.link"), F.col("i.html_url")), first_filled(F.col("i.description"), F.col("i.abstract"), F.col("i.summary")), first_filled(F.col("i.publication_date"), F.col("i.published_date"), F.col("i.date"))))
    )


def allowed_body(status: Column, body: Column) -> Column:
    """The body where the status lets it be used: success, redirects, and refusals with a body."""
    return F.when(status.isin(200, 301, 302, 303, 307, 308) | (status.isin(403, 404) & (F.coalesce(body, F.lit("")) != "")), body)


def robots_rules(body: Column) -> Column:
    """(allow, path) of the group for every agent in a robots.txt, and the paths lower-cased."""
    lines = F.transform(F.split(F.lower(F.coalesce(body, F.lit(""))), r"\r?\n"), lambda x: F.trim(x))
    rules = F.filter(lines, lambda x: x.rlike("^(dis)?allow:"))
    return F.transform(rules, lambda x: F.struct(x.startswith("allow").alias("allow"), F.trim(F.regexp_replace(x, "^(dis)?allow:", "")).alias("path")))


def robots_allowed(rules: Column, path: Column) -> Column:
    """Longest rule that begins the path decides; allowed without one."""
    hits = F.filter(rules, lambda r: (r["path"] != "") & F.lower(path).startswith(r["path"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["path"]).alias("n"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))
