"""Jobs, workflow steps and queues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake import dictionaries as D
from docketlake.functions.scoring import ratio
from docketlake.functions.text import micros
from docketlake.operators.ordered import PLACE, running


def progress(steps: DataFrame, workflow: str = "workflow_id") -> DataFrame:
    """Share of completed steps, and the final status: cancelled ▸ failed ▸ completed ▸ running."""
    done = F.count_if(F.col("status") == "completed")
    over = F.every(F.col("status").isin("completed", "failed", "cancelled"))
    final = F.when(F.some(F.col("status") == "cancelled"), "cancelled").when(F.some(F.col("status") == "failed"), "failed").when(over, "completed").otherwise("running")
    return steps.groupBy(workflow).agg(F.count("*").alias("total"), done.alias("completed"), F.round(ratio(done, F.count("*")), 6).alias("progress"), final.alias("final_status"))


def ready(steps: DataFrame) -> DataFrame:
    """Pending steps whose dependencies are all completed (workflow_id, step_id, status, dependencies)."""
    done = steps.where("status = 'completed'").select("workflow_id", F.col("step_id").alias("_dep"))
    waiting = steps.where("status = 'pending'")
    open_deps = waiting.select("workflow_id", "step_id", F.explode("dependencies").alias("_dep")).join(done, ["workflow_id", "_dep"], "left_anti").select("workflow_id", "step_id").distinct()
    return waiting.join(open_deps, ["workflow_id", "step_id"], "left_anti")


def retries(steps: DataFrame, failures: DataFrame) -> DataFrame:
    """Steps after their failures: one more retry each; pending below the limit, failed at it."""
    n = failures.groupBy("step_id").agg(F.count("*").alias("_n"))
    rows = steps.join(n, "step_id", "left")
    count = F.col("retry_count") + F.coalesce("_n", F.lit(0))
    return rows.withColumn("status", F.when(F.col("_n").isNull(), F.col("status")).when(count < F.col("max_retries"), "pending").otherwise("failed")).withColumn("retry_count", count).drop("_n")


def available(agents: DataFrame, tasks: DataFrame) -> DataFrame:
    """For each task the idle agent of its role with the shortest queue, then fewest errors, then id. One agent per role
    is chosen before the join; a task whose role has none is left out."""
    best = agents.where("status = 'idle'").groupBy("role").agg(F.min(F.struct("queue_length", "error_count", "agent_id")).alias("b")).select("role", "b.*")
    return tasks.join(best, "role")


def admitted(jobs: DataFrame, free: int) -> DataFrame:
    """The first jobs in order of creation that free places take. ``free`` is the number of places."""
    return jobs.orderBy("created_at", "job_id").limit(max(0, free))


def route(message_type: Column, recipient: Column, queues: list[str], routes: dict[str, str] = D.ROUTES) -> Column:
    """A valid recipient ▸ the type's queue ▸ null, which is the dead letters'."""
    by_type = None
    for kind, queue in routes.items():
        by_type = F.when(message_type == kind, queue) if by_type is None else by_type.when(message_type == kind, queue)
    return F.when(recipient.isin(queues), recipient).otherwise(by_type)


def dispatch(messages: DataFrame, capacity: int) -> DataFrame:
    """Messages (message_id, queue, ts) with ``outcome``: queued while the queue has room, in order; else a dead letter with its reason."""
    placed = running(messages.where("queue IS NOT NULL"), "queue", ["ts", "message_id"])
    routed = placed.withColumn("outcome", F.when(F.col(PLACE) > capacity, "queue_full").otherwise("queued")).drop(PLACE)
    return routed.unionByName(messages.where("queue IS NULL").withColumn("outcome", F.lit("no_route")))


def utilisation(messages: DataFrame, sizes: dict[str, int], alert: float = 0.8) -> DataFrame:
    """Per configured queue: messages, share of its size in percent, whether it calls for attention. Empty queues too."""
    config = messages.sparkSession.createDataFrame(list(sizes.items()), "queue string, max_size int")
    n = messages.groupBy("queue").agg(F.count("*").alias("n"))
    share = F.coalesce("n", F.lit(0)) / F.col("max_size")
    return config.join(n, "queue", "left").select("queue", F.coalesce("n", F.lit(0)).alias("n"), F.round(100 * share, 6).alias("utilisation"), (share >= alert).alias("alert"))


def live(rows: DataFrame, as_of, ttl: Column) -> DataFrame:
    """Rows whose time to live (seconds) has not passed."""
    return rows.where(micros(F.lit(as_of)) <= micros("ts") + ttl * 1_000_000)


def offline(beats: DataFrame, as_of, minutes: int = 5) -> DataFrame:
    """Per agent the last beat and whether it is older than allowed; without a beat never."""
    last = beats.groupBy("agent_id").agg(F.max("ts").alias("last_heartbeat"))
    return last.withColumn("offline", F.coalesce(micros(F.lit(as_of)) - micros("last_heartbeat") > minutes * 60_000_000, F.lit(False)))


def last_hundred(values: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Mean, median and 95th percentile (exclusive; the greatest below 20 values) of the last 100 values."""
    recent = values.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*[F.desc(o) for o in order]))).where("_n <= 100")
    held = recent.groupBy(by).agg(F.sort_array(F.collect_list("value")).alias("v"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"))
    n = F.size("v")
    h = (n + 1) * 0.95
    k = F.least(F.greatest(F.floor(h), F.lit(1)), n - 1).cast("int")
    p = F.get("v", k - 1) + (h - k) * (F.get("v", k) - F.get("v", k - 1))
    return held.select(by, n.alias("n"), "mean", "median", F.round(F.when(n < 20, F.array_max("v")).otherwise(p), 6).alias("p95"))


def smoothed(values: DataFrame, by: str, order: list[str], keep: float = 0.9) -> DataFrame:
    """Exponential mean in order, from zero; and the greatest value. Each value weighs ``keep`` to the power of how many
    came after it, so it is a plain sum."""
    later = F.row_number().over(Window.partitionBy(by).orderBy(*[F.desc(o) for o in order])) - 1
    weighed = values.withColumn("_w", F.col("value") * (1 - keep) * F.pow(F.lit(keep), later))
    return weighed.groupBy(by).agg(F.round(F.sum("_w"), 6).alias("smoothed"), F.max("value").alias("peak"))


def glob(c: Column, pattern: str) -> Column:
    """Whether ``c`` matches a shell pattern of * and ?."""
    parts = {"*": ".*", "?": "."}
    return c.rlike("^" + reduce(lambda a, ch: a + parts.get(ch, "\\" + ch if not ch.isalnum() else ch), pattern, "") + "$")
