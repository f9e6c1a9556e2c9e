"""The message stream: schema, routing to two sinks, counters, liveness, dedup within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake import dictionaries as D
from docketlake.operators.workflow import route

SCHEMA = "id string, type string, sender string, recipient string, payload string, correlation_id string, timestamp timestamp, ttl int"
DEAD_LETTER_TTL = 86400


def new_message(rows: DataFrame) -> DataFrame:
    """Fill what a message lacks: ids, time, and an hour to live."""
    return rows.withColumns({"id": F.coalesce("id", F.uuid()), "correlation_id": F.coalesce("correlation_id", F.uuid()), "timestamp": F.coalesce("timestamp", F.current_timestamp()), "ttl": F.coalesce("ttl", F.lit(3600))})


def to_json(messages: DataFrame) -> DataFrame:
    return messages.select(F.col("id").alias("key"), F.to_json(F.struct("*")).alias("value"))


def from_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.from_json("value", SCHEMA).alias("m")).select("m.*")


def read(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def routed(messages: DataFrame, queues: list[str], routes: dict[str, str] = D.ROUTES) -> DataFrame:
    return messages.withColumn("queue", route(F.col("type"), F.col("recipient"), queues, routes))


def dead_letters(messages: DataFrame, reason: str = "no_route") -> DataFrame:
    """What can't be routed, wrapped with its reason, for a day."""
    return messages.where("queue IS NULL").select(F.concat(F.lit("dl_"), "id").alias("id"), F.to_json(F.struct(*[c for c in messages.columns if c != "queue"])).alias("original"), F.lit(reason).alias("reason"), F.col("timestamp"), F.lit(DEAD_LETTER_TTL).alias("ttl"))


def write(messages: DataFrame, queue_path: str, dead_path: str, checkpoint: str):
    """Start a query that appends routed messages by queue and the others to the dead letters."""

    def batch(df: DataFrame, epoch: int) -> None:
        df = df.persist()
        df.where("queue IS NOT NULL").withColumn("epoch", F.lit(epoch)).write.mode("append").partitionBy("queue").parquet(queue_path)
        dead_letters(df).write.mode("append").parquet(dead_path)
        df.unpersist()

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters(messages: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Messages per queue and window of event time; late ones beyond the delay are not counted."""
    return messages.withWatermark("timestamp", delay).groupBy(F.window("timestamp", window), F.coalesce("queue", F.lit("dead_letter")).alias("queue")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "queue", "n")


def deduplicated(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    return messages.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["id"])


def heartbeats(messages: DataFrame, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of each sender's messages: a gap ends one, so its end is when the sender went offline."""
    return messages.withWatermark("timestamp", delay).groupBy(F.session_window("timestamp", gap), "sender").agg(F.count("*").alias("beats")).select(F.col("session_window.start").alias("online"), F.col("session_window.end").alias("offline"), "sender", "beats")
