"""Stores under repeated upserts: an append-only log of changes by bucket, compacted at times, read as the latest row of
each key.

An append writes its rows by bucket of the key and enters them in the log; writers at once each get their number, and
the later number wins. Numbers are given in turn, so a compaction replaces all entries up to the last that it saw by
their latest rows; entries that came meanwhile stay. Reading takes the last compaction and what it did not replace, and picks each key's last row
within its bucket, so that a bucket's rows meet in as many tasks as there are buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketlake.sources import log

BUCKETS = 32
#: Columns beside the rows' own: the row is gone; number of the append; place of the row in it; bucket.
GONE, NUMBER, BUCKET = "_gone", "_number", "_bucket"


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _put(rows: DataFrame, folder: str, key: str, buckets: int, record: dict) -> int:
    data = f"data/{uuid.uuid4().hex}"
    rows.withColumn(BUCKET, bucket_of(key, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{folder}/{data}")
    return log.enter(rows.sparkSession, folder, {**record, "data": data, "schema": rows.schema.json()})


def append(rows: DataFrame, folder: str, key: str, buckets: int = BUCKETS) -> int:
    """Rows that replace those of equal key. Rows of one append that repeat a key: any one of the greatest by all columns."""
    best = rows.groupBy(key).agg(F.max(F.struct(*[c for c in rows.columns if c != key])).alias("r")).select(key, "r.*").select(*rows.columns) if len(rows.columns) > 1 else rows.distinct()
    return _put(best.withColumn(GONE, F.lit(False)), folder, key, buckets, {"kind": "append"})


def remove(keys: DataFrame, folder: str, key: str, buckets: int = BUCKETS) -> int:
    """The rows of these keys are gone from now on."""
    return _put(keys.select(key).distinct().withColumn(GONE, F.lit(True)), folder, key, buckets, {"kind": "append"})


def live_entries(folder: str) -> list[tuple[int, dict]]:
    """The last compaction, if any, and the entries that it did not replace, in order."""
    files, place = log.place_of(folder)
    every = [(n, log.entry(files, place, n)) for n in log.numbers(files, place)]
    last = next((x for x in reversed(every) if x[1]["kind"] == "compaction"), None)
    upto = last[1]["upto"] if last else 0
    return [x for x in every if x is last or x[0] > upto and x[1]["kind"] != "compaction"]


def _rows(spark: SparkSession, folder: str, entries: list[tuple[int, dict]], schema: str) -> DataFrame:
    """Rows of the entries with their number; compacted rows keep the number that they had."""
    parts = []
    for n, e in entries:
        held = spark.read.schema(f"{schema}, {GONE} boolean, {NUMBER} bigint, {BUCKET} int").parquet(f"{folder}/{e['data']}")
        parts.append(held.withColumn(NUMBER, F.coalesce(NUMBER, F.lit(n).cast("bigint"))))
    out = spark.createDataFrame([], f"{schema}, {GONE} boolean, {NUMBER} bigint, {BUCKET} int")
    for p in parts:
        out = out.unionByName(p)
    return out


def _latest(rows: DataFrame, key: str) -> DataFrame:
    last = Window.partitionBy(BUCKET, key).orderBy(F.desc(NUMBER))
    return rows.withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place")


def current(spark: SparkSession, folder: str, key: str, schema: str) -> DataFrame:
    """The latest row of each key (columns as in ``schema``), without removed ones; a store without entries is empty."""
    return _latest(_rows(spark, folder, live_entries(folder), schema), key).where(~F.col(GONE)).drop(GONE, NUMBER, BUCKET)


def compact(spark: SparkSession, folder: str, key: str, schema: str, buckets: int = BUCKETS) -> int:
    """Replace what is there now by the latest rows alone; nothing that is read changes. Removed keys stay marked, so
    that an older append that comes in late doesn't bring them back."""
    entries = live_entries(folder)
    rows = _latest(_rows(spark, folder, entries, schema), key).drop(BUCKET)
    return _put(rows, folder, key, buckets, {"kind": "compaction", "upto": max((n for n, _ in entries), default=0)})
