"""A tiered cache as tables: lookups, invalidation, eviction, storage, signatures, requests shared between callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.scoring import ratio
from docketlake.functions.text import micros
from docketlake.operators.ordered import running
from docketlake.operators.workflow import glob

#: Seconds that entries live, by kind (fixed values).
TTL = {"llm_response": 86_400, "extracted_content": 604_800, "website_analysis": 86_400, "pdf_content": 2_592_000, "image_analysis": 604_800, "validation_result": 43_200, "workflow_state": 3_600}


def lookup(requests: DataFrame, tiers: dict[str, DataFrame], now: Column) -> DataFrame:
    """``requests`` (key, ...) with ``tier``: the first tier, in order, with an entry (key, expires_at) that is live; null
    is a miss. An entry without an expiry lives on. Each tier is one join on the key."""
    found = []
    for name, entries in tiers.items():
        live = entries.where(F.col("expires_at").isNull() | (micros("expires_at") > micros(now))).select("key").distinct()
        requests = requests.join(live.withColumn(f"_{name}", F.lit(name)), "key", "left")
        found.append(f"_{name}")
    return requests.withColumn("tier", F.coalesce(*found)).drop(*found)


def statistics(looked_up: DataFrame) -> DataFrame:
    """One row: hits, misses, and the share of hits (0 without requests)."""
    hits, misses = F.count("tier"), F.count("*") - F.count("tier")
    return looked_up.agg(hits.alias("hits"), misses.alias("misses"), F.round(ratio(hits, F.count("*")), 6).alias("hit_rate"))


def with_expiry(entries: DataFrame, kind: str, created: str, ttl: dict[str, int] = TTL, default: int = 3_600) -> DataFrame:
    held = F.create_map(*[F.lit(x) for kv in ttl.items() for x in kv])
    seconds = F.coalesce(F.try_element_at(held, F.col(kind)), F.lit(default))
    return entries.withColumn("expires_at", F.timestamp_micros(micros(created) + seconds.cast("long") * 1_000_000))


def storage(size: Column, packed: Column, file_above: int, budget: int) -> Column:
    """Where an entry goes (file, local, shared) and whether it is packed: if that saves a tenth of over 1024 bytes."""
    return F.struct(F.when(size > file_above, "file").when(size < budget / 10, "local").otherwise("shared").alias("tier"), ((size > 1024) & (packed <= 0.9 * size)).alias("packed"))


def without_keys(entries: DataFrame, keys: DataFrame) -> DataFrame:
    return entries.join(keys.select("key").distinct(), "key", "left_anti")


def without_matches(entries: DataFrame, pattern: str, kind: str | None = None) -> DataFrame:
    """All entries but those whose key matches a shell pattern (of a kind, if given). A null key matches nothing."""
    hit = F.coalesce(glob(F.col("key"), pattern), F.lit(False))
    return entries.where(~(hit & (F.col("kind") == kind) if kind else hit))


def without_dependents(entries: DataFrame, dependency: str) -> DataFrame:
    return entries.where(~F.coalesce(F.array_contains("dependencies", dependency), F.lit(False)))


def least_recent(entries: DataFrame, by: str) -> DataFrame:
    """Per store the key that goes first: the one not used, or else not made, for the longest; ties to the smaller."""
    used = F.coalesce("last_accessed", "created_at")
    return entries.groupBy(by).agg(F.min(F.struct(used, "key"))["key"].alias("key"))


def fitting(entries: DataFrame, by: str, budget: int) -> DataFrame:
    """Entries of each store that stay when the least recently used go until the rest fits."""
    used = F.coalesce("last_accessed", "created_at")
    return running(entries, by, [F.desc(used), F.desc("key")], "_n", _held="size").where(F.col("_held") <= budget).drop("_n", "_held")


def signature(*parts: Column, length: int = 64) -> Column:
    """Digest of the canonical JSON of named parts, in the order of their names (which callers give)."""
    return F.substring(F.sha2(F.to_json(F.struct(*parts)).cast("binary"), 256), 1, length)


def content_key(url: Column, method: Column) -> Column:
    return F.md5(F.concat_ws(":", url, method))


def shared_requests(requests: DataFrame, signature_column: str, run) -> DataFrame:
    """``requests`` with the answers of ``run`` (from distinct signatures to (signature, ...)): equal requests run once."""
    return requests.join(run(requests.select(signature_column).distinct()), signature_column, "left")


def cached_or_run(requests: DataFrame, cached: DataFrame, run) -> DataFrame:
    """Answers (key, answer, cached) of the cache, and of ``run`` for what it lacks, once per key."""
    missing = requests.select("key").distinct().join(cached.select("key"), "key", "left_anti")
    answers = cached.select("key", "answer", F.lit(True).alias("cached")).unionByName(run(missing).select("key", "answer", F.lit(False).alias("cached")))
    return requests.join(answers, "key", "left")


def batches(rows: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    """Number of the batch of ``size`` that a row of its kind belongs to, from 0."""
    return running(rows, by, order, "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def flushes(events: DataFrame, by: str, size: int, seconds: int = 5) -> DataFrame:
    """Batches per kind that are flushed by age (windows of ``seconds``) or, within these, by size: start, number, rows."""
    held = events.withColumn("_window", F.window("ts", f"{seconds} seconds")["start"])
    place = F.row_number().over(Window.partitionBy(by, "_window").orderBy("ts", "event_id"))
    return held.withColumn("_n", F.floor((place - 1) / size)).groupBy(by, F.col("_window").alias("start"), F.col("_n").cast("long").alias("number")).agg(F.count("*").alias("n"))


def backoff(retries: int = 3, base: float = 1.0) -> list[float]:
    """Seconds to wait before each retry: doubled each time."""
    return [base * 2**k for k in range(retries)]
