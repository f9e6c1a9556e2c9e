"""Queries of changes, the daily run and typed dates, each with its SQL.

Customers stand for targets, whose texts change by their number; orders for records that name their dates in words."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlake.functions import dates as D
from docketlake.operators import changes as C
from docketlake.operators import daily as Y
from docketlake.plans.catalogue import query, sql_list
from docketlake.sources.tables import read

SQL_KIND = "CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 9 = 0 THEN 'baseline' WHEN c_custkey % 4 = 0 THEN 'unchanged' ELSE 'modified' END"
SQL_RUN = f"""(SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'Content extraction failed for ' || c_name || ': timeout' WHEN c_custkey % 13 = 0 THEN 'No content extracted for ' || c_name END AS error, kind AS change,
    CASE WHEN kind = 'modified' THEN CASE c_custkey % 4 WHEN 1 THEN '1 lines added, 1 removed in Section 2' WHEN 2 THEN '1 lines added, 0 removed in Article 3' ELSE '0 lines added, 1 removed in Section 1' END END AS diff_summary,
    CASE WHEN kind = 'modified' THEN CASE c_custkey % 4 WHEN 1 THEN 0.9 WHEN 2 THEN 0.5 ELSE 0.2 END::DOUBLE END AS significance,
    CASE WHEN kind = 'modified' AND c_custkey % 4 < 3 AND c_mktsegment = 'AUTOMOBILE' THEN 'transport' WHEN kind = 'modified' AND c_custkey % 4 < 3 AND c_mktsegment = 'MACHINERY' THEN 'electrical' END AS category,
    coalesce(kind = 'modified' AND (c_mktsegment = 'AUTOMOBILE' AND c_custkey % 4 < 3 OR c_mktsegment = 'MACHINERY' AND c_custkey % 4 = 1), false) AS alert FROM (SELECT *, {SQL_KIND} AS kind FROM customer))"""


def targets(spark, d):
    """Targets with the text that was seen last, and their contents of today."""
    head, mid, end = (F.concat(F.lit(f"{t}\n{w} "), c) for t, w, c in (("Section 1", "balance", F.col("c_custkey").cast("string")), ("Section 2", "segment", F.col("c_mktsegment")), ("Article 3", "name", F.col("c_name"))))
    before = F.concat_ws("\n", head, mid, end)
    after = F.when(F.col("c_custkey") % 4 == 1, F.concat_ws("\n", head, F.concat(mid, F.lit(" changed")), end)).when(F.col("c_custkey") % 4 == 2, F.concat_ws("\n", head, mid, end, F.lit("added"))).when(F.col("c_custkey") % 4 == 3, F.concat_ws("\n", F.lit("Section 1"), mid, end)).otherwise(before)
    rows = read(spark, d, "customer").withColumns({"before": before, "after": after})
    known = F.col("c_custkey") % 9 != 0
    t = rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("u").alias("url"), F.when(known, F.sha2(F.col("before").cast("binary"), 256)).alias("last_content_hash"), F.when(known, F.col("before")).alias("baseline_content"))
    c = rows.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 11 != 0).alias("success"), F.when(F.col("c_custkey") % 13 != 0, F.col("after")).otherwise("").alias("content"), F.lit("timeout").alias("error"))
    return t, c


def run(spark, d):
    t, c = targets(spark, d)
    score = lambda text, x: F.when((x["added"] > 0) & (x["removed"] > 0), '{"significance": 0.9, "impact": "high"}').when(x["added"] > 0, '{"significance": 0.5, "impact": "medium"}').otherwise('{"significance": 0.2, "impact": "low"}')
    classify = lambda text: F.when(text.contains("AUTOMOBILE"), '{"category": "transport", "impact": "high"}').when(text.contains("MACHINERY"), '{"category": "electrical", "impact": "medium"}').otherwise('{"category": "none"}')
    return Y.daily_run(t, c, score, classify)


@query(f"SELECT c_custkey AS id, error, change, diff_summary, significance, category, alert FROM {SQL_RUN}")
def daily_run(spark, d):
    """Every target's error, change, significance, category and alert."""
    return run(spark, d).select("id", "error", "change", "diff_summary", "significance", "category", "alert")


@query(f"SELECT count(*) AS targets_monitored, count(*) FILTER (change = 'modified') AS changes_detected, count(category) AS compliance_relevant, count(*) FILTER (alert) AS high_priority_alerts, count(error) AS errors_encountered, round(100.0 * (count(*) - count(error)) / count(*), 6) AS success_rate FROM {SQL_RUN}")
def daily_summary(spark, d):
    return Y.daily_summary(run(spark, d))


@query("""SELECT c_custkey, [CASE c_custkey % 4 WHEN 1 THEN 'Section 2' WHEN 2 THEN 'Article 3' ELSE 'Section 1' END][1] AS section, (c_custkey % 4 < 3)::INT AS added, (c_custkey % 4 <> 2)::INT AS removed, true AS same FROM customer WHERE c_custkey % 4 <> 0""")
def changed_sections(spark, d):
    """Sections that a change concerns, its lines, and whether its script makes the new text of the old."""
    t, c = targets(spark, d)
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(t.withColumn("x", F.coalesce("baseline_content", F.lit(""))).drop("baseline_content"), "id")
    old = F.concat(F.lit("Section 1\nbalance "), F.col("id").cast("string"), F.lit("\nSection 2\nsegment "), F.col("c_mktsegment"), F.lit("\nArticle 3\nname "), F.col("name"))
    text = F.when(F.col("id") % 4 == 1, F.replace(old, F.lit("\nArticle 3"), F.lit(" changed\nArticle 3"))).when(F.col("id") % 4 == 2, F.concat(old, F.lit("\nadded"))).when(F.col("id") % 4 == 3, F.regexp_replace(old, "\nbalance [0-9]+", "")).otherwise(old)
    both = rows.select("id", "name").join(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment"), "id").select("id", F.posexplode(F.array(old, text)).alias("n", "text"))
    out = C.modified(both, "id", "n", "text")
    x = F.col("change_details")
    return out.select(F.col("id").alias("c_custkey"), F.get(x["sections"], 0).alias("section"), x["added"].alias("added"), x["removed"].alias("removed"), (C.patched(F.col("before"), x["script"]) == F.col("text")).alias("same"))


# typed dates
DAY = "o_orderdate::DATE"
MONTHS = {lang: sql_list(names.split()) for lang, names in D.MONTHS.items()}


def texts(spark, d):
    """Each order's text in one of four languages, with a publication, an effect and, for some, an end."""
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    late, end = F.date_add(day, 30), F.date_add(day, 400)
    name = lambda lang, x: F.get(F.array(*[F.lit(n) for n in D.MONTHS[lang].split()]), F.month(x) - 1)
    said = lambda lang, x, sep=" ": F.concat(F.dayofmonth(x).cast("string"), F.lit(sep), name(lang, x), F.lit(" "), F.year(x).cast("string"))
    iso, dotted = (lambda x: F.date_format(x, "yyyy-MM-dd")), (lambda x: F.date_format(x, "dd.MM.yyyy"))
    en = F.concat(F.lit("Published on "), said("en", day), F.lit(", it enters into force on "), iso(late), F.when(k % 8 == 0, F.concat(F.lit(" and expires "), F.date_format(end, "MM/dd/yyyy"))).otherwise(""))
    de = F.concat(F.lit("Veröffentlicht am "), said("de", day, ". "), F.lit("; tritt am "), dotted(late), F.lit(" in Kraft"), F.when(k % 8 == 1, F.concat(F.lit(" und am "), dotted(end), F.lit(" außer Kraft"))).otherwise(""))
    fr = F.concat(F.lit("Publié le "), said("fr", day), F.lit(". Il entre en vigueur le "), F.date_format(late, "dd/MM/yyyy"), F.when(k % 8 == 2, F.concat(F.lit(". Abrogé le "), said("fr", end))).otherwise(""))
    es = F.concat(F.lit("Publicada el "), said("es", day, " de "), F.lit(" y en vigor desde el "), iso(late), F.when(k % 8 == 3, F.concat(F.lit("; caduca el "), said("es", end, " de "))).otherwise(""))
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderdate").repartition("o_orderkey")  # short rows, long work: dealt to all tasks
    lang = F.get(F.array(F.lit("en"), F.lit("de"), F.lit("fr"), F.lit("es")), (k % 4).cast("int"))
    text = F.when(k % 4 == 0, en).when(k % 4 == 1, de).when(k % 4 == 2, fr).when(k % 4 == 3, es)
    # made rows, as the optimizer would make the text anew for each condition on it, and before the rows are dealt
    rows = orders.select("o_orderkey", F.inline_outer(F.array(F.struct(lang.alias("lang"), text.alias("text")))))
    return rows.withColumn("dates", D.typed_dates(F.col("text"), F.col("lang")))


@query(f"""SELECT o_orderkey, 'publication' AS kind, ({DAY})::VARCHAR AS date FROM orders UNION ALL SELECT o_orderkey, 'effective', ({DAY} + 30)::VARCHAR FROM orders UNION ALL SELECT o_orderkey, 'expiry', ({DAY} + 400)::VARCHAR FROM orders WHERE o_orderkey % 8 < 4""")
def typed_dates(spark, d):
    """Dates and their roles, read from sentences."""
    # an outer explode, as before an inner one the optimizer reads all dates once more, to see whether there are any
    return texts(spark, d).select("o_orderkey", F.explode_outer("dates").alias("x")).where("x IS NOT NULL").select("o_orderkey", "x.kind", F.col("x.date").cast("string").alias("date"))


@query(f"WITH t AS (SELECT {DAY} AS day FROM orders ORDER BY o_orderkey LIMIT 1) SELECT o_orderkey, {DAY} = day AS published_today, {DAY} + 30 = day AS effective_today FROM orders, t WHERE {DAY} = day OR {DAY} + 30 = day")
def todays_records(spark, d):
    """Records published or effective on the day of the first order."""
    on = read(spark, d, "orders").agg(F.to_date(F.min_by("o_orderdate", "o_orderkey")).alias("d")).scalar()
    # every text is searched for the day; the dates are read of those that may name it
    return D.todays(texts(spark, d).where(D.may_name(F.col("text"), on)), "dates", on).select("o_orderkey", "published_today", "effective_today")
