"""Monitoring: source listings, item filters, session reports, retention."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.scoring import percent, ratio


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal to every value that is given; None is no filter, a list means any of it."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name).isin(value) if isinstance(value, (list, tuple)) else F.col(name) == value)
    return df


def since(df: DataFrame, column: str, as_of: datetime, days: float, strict: bool = False) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``."""
    edge = F.lit(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days * 86400.0).cast("decimal(18,6)"))
    return df.where(F.col(column) > edge if strict else F.col(column) >= edge)


def source_listing(sources: DataFrame, jurisdiction=None, agency=None, source_type=None, active: bool | None = None) -> DataFrame:
    """The listing's columns: confidence with two places, last check as text or Never."""
    rows = matching(sources, jurisdiction=jurisdiction, agency=agency, source_type=source_type, is_active=active)
    return rows.select("source_id", "name", "jurisdiction", F.format_string("%.2f", "confidence").alias("confidence"), F.coalesce(F.date_format("last_checked", "yyyy-MM-dd HH:mm"), F.lit("Never")).alias("last_checked"))


def selected_sources(sources: DataFrame, ids=None, jurisdictions=None) -> DataFrame:
    """Named sources (inactive too) ▸ active ones of the jurisdictions ▸ all active ones."""
    if ids:
        return sources.where(F.col("source_id").isin(ids))
    return matching(sources.where("is_active"), jurisdiction=jurisdictions)


def agency_match(agency: Column, focus: list[str]) -> Column:
    """Whether any of the names is part of the agency's, whatever their case."""
    return reduce(lambda a, b: a | b, [F.lower(agency).contains(f.lower()) for f in focus])


def day_items(items: DataFrame, day, least: float = 0.3, types: list[str] | None = None) -> DataFrame:
    """Items found or published on the day, relevant enough, best first."""
    rows = items.where(((F.to_date("discovered_date") == F.lit(day)) | (F.to_date("published_date") == F.lit(day))) & (F.col("relevance_score") >= least))
    return matching(rows, item_type=types or None).withColumn("content_snippet", F.substring("content_snippet", 1, 200)).orderBy(F.desc("relevance_score"), "item_id")


def unseen(items: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Items whose key has not been seen, one of each (the smallest item_id)."""
    first = Window.partitionBy(key).orderBy("item_id")
    return items.join(seen.select(key).distinct(), key, "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def session_report(sessions: DataFrame, *by: str) -> DataFrame:
    """Sessions, successes, success rate in percent, items of successes and their mean, per group."""
    ok = F.col("success")
    return sessions.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.round(percent(F.count_if(ok), F.count("*")), 6).alias("success_rate"),
        F.round(F.coalesce(F.sum(F.when(ok, F.col("items"))), F.lit(0.0)), 6).alias("total_items"), F.round(F.coalesce(F.avg(F.when(ok, F.col("items"))), F.lit(0.0)), 6).alias("avg_items"),
    )


def last_n(df: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """The n last rows of each group, with their number from the end."""
    return df.withColumn("recency", F.row_number().over(Window.partitionBy(by).orderBy(*[F.desc(c) for c in order]))).where(F.col("recency") <= n)


def zero_filled(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Row counts of each value, those without rows and unexpected ones too."""
    counts = df.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(F.count("*").alias("n"))
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return wanted.join(counts, column, "full_outer").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def discovery_statistics(sources: DataFrame) -> DataFrame:
    """Counts and mean confidence by jurisdiction, by agency, by type and in all, in one pass."""
    keys = [F.col(c) for c in ("jurisdiction", "agency", "source_type")]
    sums = [F.count("*").alias("n"), F.count_if("is_active").alias("n_active"), F.round(F.avg("confidence"), 6).alias("avg_confidence")]
    return sources.groupingSets([[keys[0]], [keys[1]], [keys[2]], []], *keys).agg(F.grouping_id().alias("level"), *sums).select("level", "jurisdiction", "agency", "source_type", "n", "n_active", "avg_confidence")


def feed_metrics(sessions: DataFrame) -> DataFrame:
    """One row: feeds per source, items per source, share of relevant items (0 where nothing is to divide by)."""
    s = sessions.agg(F.sum("feeds_ok").alias("f"), F.sum("sources").alias("s"), F.sum("new_items").alias("n"), F.sum("relevant").alias("r"))
    return s.select(F.round(percent(F.col("f"), F.col("s")), 6).alias("success_rate"), F.round(ratio(F.col("n"), F.col("s")), 6).alias("items_per_source"), F.round(percent(F.col("r"), F.col("n")), 6).alias("relevance_rate"))


def advice(rates: DataFrame) -> DataFrame:
    """Per source: what its mean relevance and success rate call for."""
    return rates.withColumn("advice", F.array_compact(F.array(
        F.when(F.col("avg_relevance") >= 0.8, "excellent sources").when(F.col("avg_relevance") < 0.5, "refine patterns"),
        F.when(F.col("success_rate") < 70, "improve success"), F.when(F.col("avg_items") < 2, "few items"))))
