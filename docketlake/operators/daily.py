"""The daily run over monitored targets: contents against what was seen last, changes scored, classified, alerted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions.model import classification
from docketlake.functions.scoring import percent
from docketlake.operators.changes import line_changes, significance, summary
from docketlake.shipping import ship_package

#: Impacts of a change that are classified, impacts on business that alert, the significance that does (fixed values).
CLASSIFIED, URGENT, ALERT_ABOVE = ("high", "medium"), ("critical", "high"), 0.7
NOT_RELEVANT = "not_product_compliance"
#: What is said of a target that could not be read (fixed values).
FAILED, EMPTY = "Content extraction failed for ", "No content extracted for "


def monitored(targets: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The targets of the given ids (column id), all without; ids that have no target are skipped."""
    return targets if ids is None else targets.join(ids.select("id").distinct(), "id", "left_semi")


def daily_run(targets: DataFrame, contents: DataFrame, score: Callable[[Column, Column], Column], classify: Callable[[Column], Column], ids: DataFrame | None = None) -> DataFrame:
    """A row for each monitored target: error (null without), change (baseline, unchanged, modified), what changed, its
    significance and impact, category and business impact where it was classified, and whether it alerts.

    targets: (id, name, url, last_content_hash, baseline_content); contents: (id, success, content, error), one for each
    id. score(text, details) and classify(text) give a scorer's replies. A target without contents is an error. Texts
    are compared only where the hashes differ."""
    ship_package(targets.sparkSession)
    rows = monitored(targets, ids).select("id", "name", "url", "last_content_hash", "baseline_content").join(contents.select("id", "success", "content", F.col("error").alias("_said")), "id", "left")
    failed = ~F.coalesce(F.col("success"), F.lit(False))
    empty = F.coalesce(F.col("content"), F.lit("")) == ""
    error = F.when(failed, F.concat(F.lit(FAILED), F.col("name"), F.lit(": "), F.coalesce("_said", F.lit("None")))).when(empty, F.concat(F.lit(EMPTY), F.col("name")))
    now = F.sha2(F.col("content").cast("binary"), 256)
    change = F.when(F.col("error").isNull(), F.when(F.col("last_content_hash").isNull(), "baseline").when(F.col("last_content_hash") == now, "unchanged").otherwise("modified"))
    rows = rows.withColumn("error", error).withColumn("change", change)
    modified = F.col("change") == "modified"
    same = rows.where(~F.coalesce(modified, F.lit(False)))
    new = rows.where(modified).withColumn("_d", line_changes("baseline_content", "content"))
    new = new.withColumn("_s", significance(score(F.col("content"), F.col("_d"))))
    classified = F.col("_s.impact").isin(*CLASSIFIED)
    new = new.withColumn("_c", F.when(classified, classification(classify(F.col("content")))))
    relevant = classified & (F.col("_c.category") != NOT_RELEVANT)
    alert = relevant & (F.col("_c.impact").isin(*URGENT) | (F.col("_s.significance") > ALERT_ABOVE))
    out = {
        "diff_summary": summary(F.col("_d")), "affected_sections": F.col("_d.sections"), "significance": F.col("_s.significance"), "impact": F.col("_s.impact"),
        "category": F.when(relevant, F.col("_c.category")), "business_impact": F.when(relevant, F.col("_c.impact")), "relevant": F.coalesce(relevant, F.lit(False)), "alert": F.coalesce(alert, F.lit(False)),
    }
    keep = ["id", "name", "url", "error", "change"]
    none = {k: F.lit(False) if k in ("relevant", "alert") else F.lit(None).cast({"affected_sections": "array<string>", "significance": "double"}.get(k, "string")) for k in out}
    return new.select(*keep, *(c.alias(k) for k, c in out.items())).unionByName(same.select(*keep, *(c.alias(k) for k, c in none.items())))


def daily_summary(rows: DataFrame) -> DataFrame:
    """One row: targets, changes, relevant ones, alerts, errors, and the success rate in percent (of one target at least)."""
    n, errors = F.count("*"), F.count("error")
    return rows.agg(n.alias("targets_monitored"), F.count_if(F.col("change") == "modified").alias("changes_detected"), F.count_if("relevant").alias("compliance_relevant"), F.count_if("alert").alias("high_priority_alerts"), errors.alias("errors_encountered"), F.round(percent(n - errors, F.greatest(n, F.lit(1))), 6).alias("success_rate"))


def checked_targets(targets: DataFrame, contents: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """The targets after the run: those read hold the new text, its hash and the time."""
    good = rows.where("error IS NULL").select("id").join(contents.select("id", F.col("content").alias("_text")), "id")
    out = targets.join(good, "id", "left")
    read = F.col("_text").isNotNull()
    return out.withColumns({"baseline_content": F.when(read, F.col("_text")).otherwise(F.col("baseline_content")), "last_content_hash": F.when(read, F.sha2(F.col("_text").cast("binary"), 256)).otherwise(F.col("last_content_hash")), "last_checked": F.when(read, now).otherwise(F.col("last_checked"))}).select(*targets.columns)
