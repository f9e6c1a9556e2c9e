"""Queries that run streams over the tables, with SQL over the same tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docketlake.plans.catalogue import query
from docketlake.sources.tables import read, shared_path
from docketlake.streaming import queue as Q
from docketlake.streaming import stateful as S

UNTIL = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)"
SQL_TRANSITIONS = f"""WITH b AS (SELECT user_id::VARCHAR AS key, ts, lag(ts) OVER w AS before, lead(ts) OVER w AS after FROM events WHERE ts <= {UNTIL} WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    SELECT key, 'idle' AS status, ts AS at FROM b WHERE before IS NULL OR ts - before > INTERVAL 5 MINUTE UNION ALL SELECT key, 'offline', ts + INTERVAL 5 MINUTE FROM b WHERE coalesce(after, {UNTIL}) - ts > INTERVAL 5 MINUTE"""


@query(SQL_TRANSITIONS)
def agent_transitions(spark, d):
    """When each agent (user) was heard again and when it fell silent, from the table."""
    e = read(spark, d, "events")
    until = e.agg((F.date_trunc("millisecond", F.max("ts")) - F.expr("INTERVAL 10 MINUTES")).alias("u")).scalar()
    return S.transitions(e, "user_id", "ts", until)


@query(SQL_TRANSITIONS)
def streamed_transitions(spark, d):
    """The same from the events as a stream, with state and timers."""
    events = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern, as the table may be one file
    place = f"{shared_path(spark)}/transitions_{uuid.uuid4().hex}"
    S.written(S.liveness(events, "user_id", "ts", "event_id"), f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return spark.read.schema(S.STATUS).parquet(f"{place}/out")


@query("SELECT event_id::VARCHAR AS id, event_type AS type, props AS payload FROM events")
def queued_messages(spark, d):
    """Events published to a queue and consumed as a stream."""
    none = F.lit(None).cast("string")
    e = read(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("sender"), none.alias("recipient"), F.col("props").alias("payload"), none.alias("correlation_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.lit(60).alias("ttl"))
    place = f"{shared_path(spark)}/queue_{uuid.uuid4().hex}"
    Q.publish(e, f"{place}/queue")
    run = Q.consume(spark, f"{place}/queue").writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").start()
    run.processAllAvailable()
    run.stop()
    return spark.read.parquet(f"{place}/out").select("id", "type", "payload")
