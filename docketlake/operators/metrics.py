"""Daily metrics that can be merged: one row for each agent and day, with sketches of what no sum can tell.

A day's row holds counts, sums, least and greatest, a quantile sketch of the seconds and a sketch of the most frequent
errors; any range of days or agents is the merge of its rows, without the events. Quantiles of the sketch are off by at
most 1.65 / K of the ranks or so (and exact below K values), frequencies are exact below ``ERRORS`` distinct errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the quantile sketch; errors that are tracked.
K, ERRORS = 4096, 1000


def daily_metrics(runs: DataFrame, *by: str | Column) -> DataFrame:
    """runs: (seconds, success, error) with what ``by`` groups (agent, day). A null error, or a success, is none."""
    failed = ~F.coalesce(F.col("success"), F.lit(False))
    told = F.when(failed, F.col("error"))
    return runs.withColumn("_told", told).groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(failed).alias("failed"), F.count("seconds").alias("timed"), F.sum("seconds").alias("seconds"), F.min("seconds").alias("least"), F.max("seconds").alias("greatest"),
        F.kll_sketch_agg_double(F.col("seconds").cast("double"), F.lit(K)).alias("times"), F.call_function("approx_top_k_accumulate", F.col("_told"), F.lit(ERRORS)).alias("errors"))


def merged(days: DataFrame, *by: str | Column) -> DataFrame:
    """Rows of days merged by what is given (nothing: one row)."""
    sums = [F.sum(c).alias(c) for c in ("n", "failed", "timed", "seconds")]
    keys = by or (F.lit(0).alias("_all"),)  # the sketches' merge needs a group
    return days.groupBy(*keys).agg(*sums, F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.kll_merge_agg_double("times", F.lit(K)).alias("times"), F.call_function("approx_top_k_combine", F.col("errors"), F.lit(ERRORS)).alias("errors")).drop("_all")


def report(days: DataFrame, top: int = 3) -> DataFrame:
    """What the rows say: success rate, mean, median and 95th percentile of the seconds, the most frequent errors."""
    at = F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("times", F.array(F.lit(0.5), F.lit(0.95))))
    errors = F.filter(F.call_function("approx_top_k_estimate", F.col("errors"), F.lit(top + 1)), lambda e: e["item"].isNotNull())
    rest = [c for c in days.columns if c not in ("times", "errors", "failed", "timed", "seconds", "least", "greatest", "n")]
    return days.select(
        *rest, "n", F.round(1 - F.col("failed") / F.col("n"), 6).alias("success_rate"), F.round(F.col("seconds") / F.nullif("timed", F.lit(0)), 6).alias("mean"), "least", "greatest",
        F.get(at, 0).alias("median"), F.get(at, 1).alias("p95"), F.slice(errors, 1, top).alias("common_errors"))
