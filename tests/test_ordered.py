"""Places, running sums and last values against plain windows, whatever the ranges."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docketlake.operators import coordination, ordered


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    data = [(r.choice(["hot"] * 8 + ["a", None]), r.randrange(50), i, float(r.randrange(10)) if i % 7 else None) for i in range(2000)]
    return spark.createDataFrame(data, "g string, t int, id int, value double").repartition(5)


def test_running(spark, rows):
    order = Window.partitionBy("g").orderBy(F.desc("t"), "id")
    want = rows.withColumns({"n": F.row_number().over(order), "s": F.coalesce(F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))})
    got = ordered.running(rows, "g", [F.desc("t"), "id"], "n", s="value")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert ordered.running(rows.limit(0), "g", ["id"]).count() == 0


def test_a_group_spreads_over_ranges(spark, rows):
    parts = ordered.dealt(rows, ["g"], [F.col("t"), F.col("id")], 8).where("g = 'hot'").groupBy("_range").count().collect()
    assert len(parts) > 1 and max(p["count"] for p in parts) < 1600


@pytest.mark.parametrize("chunk", [7, 100, 10_000])
def test_recent_and_extremes(spark, rows, chunk):
    known = rows.where("value IS NOT NULL AND g IS NOT NULL")
    order = Window.partitionBy("g").orderBy("t", "id")
    numbered = ordered.running(known, "g", ["t", "id"], "_n")
    want = known.withColumns({"m": F.round(F.avg("value").over(order.rowsBetween(-4, 0)), 6), "least": F.min("value").over(order.rowsBetween(Window.unboundedPreceding, 0)), "greatest": F.max("value").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    got = coordination.extremes(ordered.recent(numbered, "g", "_n", 5, F.avg("value"), "m", chunk).withColumn("m", F.round("m", 6)), "g", chunk).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
