"""Document features composed of the column builders: identity, structure, technology, advice; pages read in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake import dictionaries as D
from docketlake.functions import scoring as S
from docketlake.functions import text as X
from docketlake.functions import urls as U
from docketlake.operators.records import record_status

#: Minutes that a method takes.
MINUTES = {"html_parsing": 3, "pdf_extraction": 8, "vision_processing": 12, "validation": 2}


def identity(title: Column, text: Column, url: Column) -> Column:
    """Number, first written date, jurisdiction by host else by phrases, type by address else by words, status."""
    low = F.lower(url)
    by_url = F.when(low.contains("regulation"), "regulation").when(low.contains("act"), "act").when(low.contains("bill"), "bill").when(low.contains("directive"), "directive")
    return F.struct(
        X.first_group(F.concat_ws(" ", title, text), [X.engine_form(p, True) for p in D.NUMBER_PATTERNS]).alias("number"), X.first_group(text, [X.engine_form(p, True) for p in D.WRITTEN_DATES]).alias("date"),
        F.coalesce(U.jurisdiction(url), X.best_label(text, D.JURISDICTION_PHRASES)).alias("jurisdiction"), F.coalesce(by_url, X.best_label(text, D.DOCUMENT_TYPES, "other")).alias("document_type"), record_status(text).alias("status"))


def issues(n_chars: Column, n_sections: Column, n_metadata: Column, has_title: Column, has_date: Column, has_authority: Column) -> Column:
    """Labels of what a record lacks."""
    return F.array_compact(F.array(F.when(~has_title, "missing title"), F.when(n_chars < 500, "short content"), F.when(n_sections == 0, "no sections"), F.when(n_metadata < 3, "little metadata"), F.when(~has_date, "missing date"), F.when(~has_authority, "missing authority")))


def advice(found: Column) -> Column:
    """What to do about each kind of issue, once each."""
    return F.array_distinct(F.transform(found, lambda i: F.when(i.startswith("missing"), "look up metadata").when(i == "no sections", "extract structure again").when(i == "short content", "follow links").otherwise("review by hand")))


def technology(html: Column) -> Column:
    low = F.lower(html)
    scripts = F.regexp_count(low, F.lit("<script"))
    spa = X.presence_count(html, D.SPA_FRAMEWORKS) > 0
    return F.struct(X.labels_present(html, D.FRAMEWORKS).alias("frameworks"), scripts.cast("long").alias("scripts"), F.round(S.points((scripts > 5, 0.3), (spa, 0.4), (low.contains("loading...") | low.contains("spinner"), 0.3)), 6).alias("needs_scripts"), F.round(F.least(F.lit(1.0), 0.2 * X.presence_count(html, D.API_TERMS)), 6).alias("api_readiness"))


def extraction_plan(n_sections: Column, n_tables: Column, n_links: Column, pdf_share: Column) -> Column:
    """Methods to use on a page."""
    return F.array_compact(F.array(F.lit("html"), F.when(n_sections == 0, "javascript"), F.when(n_tables > 0, "tables"), F.when(n_links > 10, "link_following"), F.when(pdf_share > 0.1, "pdf")))


def plan_minutes(methods: Column) -> Column:
    """Minutes for the methods, three for one that isn't known."""
    held = F.create_map(*[F.lit(x) for kv in MINUTES.items() for x in kv])
    return F.aggregate(methods, F.lit(0), lambda a, m: a + F.coalesce(F.try_element_at(held, m), F.lit(3)))


def document_estimate(n_documents: Column, n_pages: Column, n_links: Column) -> Column:
    """Documents behind a listing: by half the pages, by twice the direct links, or a third of all links; up to 10,000."""
    d = F.when(n_pages > 5, n_documents * F.floor(n_pages / 2)).when(n_documents > 0, n_documents * 2).otherwise(F.greatest(F.lit(10), F.floor(n_links / 3)))
    return F.least(F.lit(10_000), d).cast("long")


def follow_pages(links: DataFrame, starts: DataFrame, max_pages: int = 10) -> DataFrame:
    """(start, url, n): the pages reached from each start (url) over (url, next_url), up to ``max_pages``; a page met
    again ends the walk. Of several links of a page the least counts; a start that repeats is walked once.

    By pointer doubling: each round joins, to the walks of a length, the walks of that length from their last page, so
    that the number of joins is the logarithm of the pages. A walk is a row with its pages as an array."""
    step = links.where("next_url IS NOT NULL AND url IS NOT NULL").groupBy("url").agg(F.min("next_url").alias("next_url"))
    begin = starts.select("url").where("url IS NOT NULL").distinct()
    # trail: the pages after ``url``; whole: it did not end within them
    walks, length = step.select("url", F.array("next_url").alias("trail")), 1
    rows = begin.select("url", F.array("url").alias("pages"))
    left = max_pages - 1
    while left > 0:
        if left % (2 * length) >= length:  # this length is part of the sum
            side = walks.select(F.col("url").alias("at"), "trail")
            rows = rows.join(side, F.element_at("pages", -1) == F.col("at"), "left").select("url", F.concat("pages", F.coalesce("trail", F.array().cast(dict(walks.dtypes)["trail"]))).alias("pages"))
            left -= length
        if left:
            side = walks.select(F.col("url").alias("at"), F.col("trail").alias("more"))
            walks = walks.join(side, F.element_at("trail", -1) == F.col("at"), "left").select("url", F.concat("trail", F.coalesce("more", F.array().cast(dict(walks.dtypes)["trail"]))).alias("trail"))
            length *= 2
    seen = F.transform(F.col("pages"), lambda p, i: F.array_position("pages", p) == i + 1)
    first_repeat = F.coalesce(F.nullif(F.array_position(seen, F.lit(False)), F.lit(0)), F.size("pages") + 1)
    return rows.select(F.col("url").alias("start"), F.posexplode(F.slice("pages", F.lit(1), (first_repeat - 1).cast("int"))).alias("n", "url")).select("start", "url", (F.col("n") + 1).alias("n"))


def merged_pages(pages: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Texts of a document's pages in order, parted by blank lines, with their number and words."""
    held = pages.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["t"]), "\n\n")
    return held.select(key, F.size("p").alias("n_pages"), whole.alias("text"), X.word_count(whole).alias("n_words"))


def ocr_lines(words: DataFrame, least: int = 0) -> DataFrame:
    """Lines of recognised words (image, line_num, word_num, text, conf): text in order, mean confidence of the words
    above ``least``; empty words are left out."""
    kept = words.where((F.trim("text") != "") & (F.col("conf") > least))
    return kept.groupBy("image", "line_num").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_num", "text"))), lambda x: x["text"]), " ").alias("line"), F.round(F.avg("conf"), 6).alias("confidence"))
