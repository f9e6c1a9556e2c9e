"""Places and running sums within groups of any size: no task takes a whole group.

Rows are dealt in ranges by group and order, so that a large group spreads over many ranges; each range numbers its own
part, and a small table of counts by range and group tells what comes before. The dealt rows are written once, since
both steps must see the same ranges."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.sources.tables import shared_path

RANGE, PLACE = "_range", "_place"


def dealt(rows: DataFrame, by: list[str], order: list[Column], ranges: int | None = None) -> DataFrame:
    """``rows`` with the number of their range (of as many as the session has for shuffles, unless it is said), written
    to the shared folder."""
    spark = rows.sparkSession
    path = f"{shared_path(spark)}/ranges_{uuid.uuid4().hex}"
    keys = [*[F.col(b) for b in by], *order]
    placed = rows.repartitionByRange(ranges, *keys) if ranges else rows.repartitionByRange(*keys)
    placed.withColumn(RANGE, F.spark_partition_id()).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def running(rows: DataFrame, by: str | list[str], order: list[str | Column], place: str = PLACE, **sums: str) -> DataFrame:
    """``rows`` with ``place`` (from 1) within their group in the order, and, for each name=column, the sum up to the row.

    The order must tell rows of a group apart for a definite result. Null values of a sum count as 0; rows with a null
    group form one."""
    by = [by] if isinstance(by, str) else by
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    held = dealt(rows, by, keys)
    totals = {place: F.count("*"), **{n: F.coalesce(F.sum(c), F.lit(0)) for n, c in sums.items()}}
    counts = held.groupBy(RANGE, *by).agg(*[t.alias(f"_b_{n}") for n, t in totals.items()])
    before = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = counts.select(F.col(RANGE).alias("_r"), *[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], *[F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals])
    own = Window.partitionBy(RANGE, *by).orderBy(*keys)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    local = held.withColumns({f"_l_{place}": F.row_number().over(own), **{f"_l_{n}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in sums.items()}})
    same = F.col(RANGE) == F.col("_r")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_g{i}"))
    joined = local.join(offsets, same)
    return joined.select(*rows.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in totals])


def recent(rows: DataFrame, by: str, place: str, keep: int, value: Column, name: str, chunk: int = 10_000) -> DataFrame:
    """``rows`` (numbered by ``place``) with ``name``: the aggregate ``value`` over the last ``keep`` rows of the group,
    the row included. Groups are cut into chunks, each with what it needs of the one before."""
    size = max(chunk, keep)
    at = F.floor((F.col(place) - 1) / size)
    copies = F.when(F.pmod(F.col(place) - 1, F.lit(size)) >= size - keep + 1, F.array(at, at + 1)).otherwise(F.array(at))
    dealt_rows = rows.withColumn("_home", at).withColumn("_chunk", F.explode(copies))
    window = Window.partitionBy(by, "_chunk").orderBy(place).rowsBetween(1 - keep, 0)
    return dealt_rows.withColumn(name, value.over(window)).where("_chunk = _home").drop("_home", "_chunk")
