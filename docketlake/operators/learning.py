"""Pattern learning: confidence updates, common patterns, best patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, new: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """``table`` with rows of ``new`` replacing those of equal key; the last by ``seq`` if new ones repeat."""
    if seq:
        last = Window.partitionBy(key).orderBy(F.desc(seq))
        new = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return table.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_absent(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return table.unionByName(new.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def short_id(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", *parts)), 1, 12)


def use_totals(events: DataFrame, key: str) -> DataFrame:
    """Closed form of the running updates: successes, failures, confidence, means over positive values."""
    s, f = F.count_if("success"), F.count_if(~F.col("success"))
    return events.groupBy(key).agg(s.alias("success_count"), f.alias("failure_count"), F.round(s / (s + f), 6).alias("confidence"),
        F.round(F.avg(F.when(F.col("success") & (F.col("items") > 0), F.col("items"))), 6).alias("avg_items"))


def running_confidence(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """After each event: number, confidence and mean items so far."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n, ok = F.count("*").over(so_far), F.count_if("success").over(so_far)
    return events.withColumns({"n": n, "running_confidence": F.round(ok / n, 6), "running_items": F.round(F.avg("items").over(so_far), 9)})


def reinforced(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Confidence after all uses in order. A success sets s / (s + f), adds min(.05, .003 * items) from 10 items on,
    (10 - t) / 100 below 10 s, and .01, up to 1. A failure sets s / (s + f) and, from 5 attempts on with over half
    failed, takes min(.1, .1 * rate), down to 0. Since every use starts from s / (s + f), the totals and the last use
    tell the end."""
    s, f = F.count_if("success"), F.count_if(~F.col("success"))
    held = events.groupBy(key).agg(s.alias("success_count"), f.alias("failure_count"), F.max_by(F.struct("success", "items", "seconds"), F.struct(*order)).alias("last"))
    n, x = F.col("success_count") + F.col("failure_count"), F.col("last")
    base, rate = F.col("success_count") / n, F.col("failure_count") / n
    up = base + F.when(x["items"] >= 10, F.least(F.lit(0.05), 0.003 * x["items"])).otherwise(0.0) + F.when((x["seconds"] > 0) & (x["seconds"] < 10), (10 - x["seconds"]) / 100).otherwise(0.0) + 0.01
    down = base - F.when((n >= 5) & (rate > 0.5), F.least(F.lit(0.1), 0.1 * rate)).otherwise(0.0)
    confidence = F.when(x["success"], F.least(F.lit(1.0), up)).otherwise(F.greatest(F.lit(0.0), down))
    return held.select(key, "success_count", "failure_count", F.round(confidence, 6).alias("confidence"))


def best(df: DataFrame, by: str, score: str, least: float, tie: str, n: int = 1) -> DataFrame:
    """The best rows of each group, of those good enough."""
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return df.where(F.col(score) >= least).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def common_values(df: DataFrame, value: str, least: int = 2, distinct: str | None = None) -> DataFrame:
    """Values that ``least`` rows (or distinct values of another column) share."""
    n = F.countDistinct(distinct) if distinct else F.count("*")
    return df.groupBy(value).agg(n.alias("n")).where(F.col("n") >= least)


def pattern_statistics(patterns: DataFrame) -> DataFrame:
    """Per jurisdiction: sources, patterns, patterns of confidence .8 and more."""
    return patterns.groupBy("jurisdiction").agg(F.countDistinct("source_id").alias("sources"), F.count("*").alias("patterns"), F.count_if(F.col("confidence") >= 0.8).alias("high_confidence"))


def recommendations(sources: DataFrame) -> DataFrame:
    """Rows (source_id, priority, action) from sessions, success_rate (0 to 1) and weak_patterns."""
    rows = F.array_compact(F.array(
        F.when(F.col("sessions") < 5, F.struct(F.lit("high").alias("priority"), F.lit("data_collection").alias("action"))),
        F.when(F.col("weak_patterns") > 0, F.struct(F.lit("medium").alias("priority"), F.lit("optimisation").alias("action"))),
        F.when((F.col("sessions") >= 5) & (F.col("success_rate") < 0.7), F.struct(F.lit("medium").alias("priority"), F.lit("opportunity").alias("action")))))
    return sources.select("source_id", F.explode(rows).alias("r")).select("source_id", "r.*")
