"""Learned extraction patterns: induced from pages whose items are known, tried on others, reinforced by their success.

A pattern is a path of tags from an element upwards, written as a selector (``nav > ul > li > a``). Patterns are data:
each source has its own, and a page tries its source's best ones, so paths are compared step by step in the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.model import once
from docketlake.operators.learning import short_id
from docketlake.sources import dom

#: Steps of a path, patterns tried on a page, their least confidence.
STEPS, TRIED, LEAST = 6, 3, 0.6


def step_of(tree: Column, element: Column) -> Column:
    """An element's step: its tag, with its first class if it has one."""
    name = F.split_part(F.trim(F.get(tree["classes"], element)), F.lit(" "), F.lit(1))
    return F.concat(F.get(tree["tag"], element), F.when(name != "", F.concat(F.lit("."), name)).otherwise(""))


def path_up(tree: Column, element: Column, steps: int = STEPS) -> Column:
    """Steps from the element upwards, ``steps`` at most."""
    begin = F.struct(element.alias("at"), F.array().cast("array<string>").alias("path"))

    def climb(s: Column, _: Column) -> Column:
        up = F.struct(F.get(tree["parent"], s["at"]).alias("at"), F.array_append(s["path"], step_of(tree, s["at"])).alias("path"))
        return F.when(s["at"] >= 0, up).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, climb, lambda s: s["path"])


def induced(pages: DataFrame, examples: DataFrame, steps: int = STEPS, least: int = 2) -> DataFrame:
    """(source_id, pattern_id, pattern_value, n): the longest path that a source's example items share, from the item up.

    pages: (page_id, source_id, tree); examples: (page_id, href) of links that are items. A source needs ``least``
    examples. Steps are counted, not gathered: each example sends one short row a step."""
    links = F.filter(dom.numbers(F.col("tree")), lambda i: (F.get(F.col("tree.tag"), i) == "a") & dom.attribute(F.col("tree"), i, "href").isNotNull())
    held = pages.select("page_id", "source_id", F.explode(F.transform(links, lambda i: F.struct(dom.attribute(F.col("tree"), i, "href").alias("href"), path_up(F.col("tree"), i, steps).alias("path")))).alias("x")).select("page_id", "source_id", "x.href", "x.path")
    known = held.join(examples.select("page_id", "href").distinct(), ["page_id", "href"], "left_semi")
    counts = known.select("source_id", F.posexplode("path").alias("k", "step")).groupBy("source_id", "k", "step").agg(F.count("*").alias("n"))
    best = counts.groupBy("source_id", "k").agg(F.max("n").alias("n"), F.max_by("step", F.struct("n", "step")).alias("step"))
    every = best.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("k", "n", "step"))).alias("s"))  # at most ``steps`` entries
    n = F.col("s")[0]["n"]  # steps agree while as many examples share them as share the first
    agreed = F.filter("s", lambda x: F.forall(F.filter(F.col("s"), lambda y: y["k"] <= x["k"]), lambda y: y["n"] == n))
    value = F.array_join(F.reverse(F.transform(agreed, lambda x: x["step"])), " > ")
    return every.where((n >= least) & (F.size(agreed) > 0)).select("source_id", short_id(F.col("source_id").cast("string"), value).alias("pattern_id"), value.alias("pattern_value"), n.alias("n"))


def learned(patterns: DataFrame, found: DataFrame) -> DataFrame:
    """Patterns (source_id, pattern_id, pattern_value, success_count, failure_count) with those induced: a new one
    begins with one success, a known one gains one. Confidence is the share of successes."""
    new = found.select("source_id", "pattern_id", "pattern_value", F.lit(1).cast("long").alias("success_count"), F.lit(0).cast("long").alias("failure_count"))
    rows = patterns.select(*new.columns).unionByName(new).groupBy("source_id", "pattern_id", "pattern_value").agg(F.sum("success_count").alias("success_count"), F.sum("failure_count").alias("failure_count"))
    return rows.withColumn("confidence", F.round(F.col("success_count") / (F.col("success_count") + F.col("failure_count")), 6))


def matched(tree: Column, pattern: Column) -> Column:
    """Numbers of the elements whose path ends as the pattern does; a step without a class meets any."""
    wanted = F.reverse(F.split(pattern, r"\s*>\s*"))

    def meets(i: Column) -> Column:
        return once(path_up(tree, i), lambda p: (F.size(p) >= F.size(wanted)) & F.forall(F.zip_with(wanted, p, lambda w, s: w.isNull() | (w == s) | (w == F.split_part(s, F.lit("."), F.lit(1)))), lambda ok: F.coalesce(ok, F.lit(False))))

    last = F.split_part(F.get(wanted, 0), F.lit("."), F.lit(1))
    return F.filter(F.filter(dom.numbers(tree), lambda i: F.get(tree["tag"], i) == last), meets)


def tried(pages: DataFrame, patterns: DataFrame, tries: int = TRIED, least: float = LEAST, limit: int = 20) -> DataFrame:
    """``pages`` (page_id, source_id, url, tree) with items (title, url), and ``pattern_id`` of the pattern that found
    them: the first of the source's best ones (confidence, then pattern_id) to find any; without one no items.

    Of the patterns, at most ``tries`` for each source reach a page."""
    order = Window.partitionBy("source_id").orderBy(F.desc("confidence"), "pattern_id")
    top = patterns.where(F.col("confidence") >= least).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= tries)
    lists = top.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("_n", "pattern_id", "pattern_value"))).alias("_p"))
    tree = F.col("tree")
    runs = F.transform(F.coalesce(F.col("_p"), F.array().cast(dict(lists.dtypes)["_p"])), lambda p: F.struct(p["pattern_id"].alias("pattern_id"), dom.items(tree, matched(tree, p["pattern_value"]), F.col("url"), limit).alias("items")))
    rows = pages.join(lists, "source_id", "left").withColumn("_r", F.get(F.filter(runs, lambda r: F.size(r["items"]) > 0), 0))
    return rows.select(*pages.columns, F.col("_r.pattern_id").alias("pattern_id"), F.coalesce("_r.items", F.array().cast("array<struct<title:string,url:string>>")).alias("items"))


def outcomes(pages: DataFrame) -> DataFrame:
    """Uses of patterns (pattern_id, success, items), to be added up by ``learning.use_totals``."""
    return pages.where(F.col("pattern_id").isNotNull()).select("pattern_id", (F.size("items") > 0).alias("success"), F.size("items").cast("double").alias("items"))
