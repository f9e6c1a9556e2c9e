"""Coordinator's view: messages in queues, agents, workflows, their metrics, and the steps of a workflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.scoring import ratio
from docketlake.operators.ordered import recent, running
from docketlake.operators.workflow import available

#: Steps of an extraction: step, role, dependencies, and the option that asks for it (fixed values).
STEPS = [
    ("discovery", "discovery", [], None),
    ("orchestration", "orchestrator", ["discovery"], None),
    ("html_extraction", "html_extractor", ["orchestration"], None),
    ("pdf_analysis", "pdf_analyzer", ["orchestration"], "include_pdf"),
    ("vision_processing", "vision_processor", ["orchestration"], "include_vision"),
    ("validation", "content_validator", ["html_extraction"], None),
]


# messages
def requeued(dead: DataFrame, queue: Column, limit: int = 100) -> DataFrame:
    """Of the first ``limit`` dead letters (message_id, ts) those that find a queue again, up to the first that doesn't."""
    rows = dead.orderBy("ts", "message_id").limit(limit).withColumn("queue", queue)
    numbered = rows.withColumn("n", F.row_number().over(Window.orderBy("ts", "message_id")))  # at most ``limit`` rows
    stop = numbered.where("queue IS NULL").agg(F.min("n")).scalar()
    return numbered.where(F.coalesce(F.col("n") < stop, F.lit(True)))


def purged(messages: DataFrame, queue: str) -> tuple[DataFrame, DataFrame]:
    """What stays when a queue is cleared, and one row with how many messages went."""
    gone = F.coalesce(F.col("queue") == queue, F.lit(False))
    return messages.where(~gone), messages.agg(F.count_if(gone).alias("purged"))


def counters(events: DataFrame) -> DataFrame:
    """Per queue and action (queued, processed, failed): how many. Purges are not counted."""
    return events.where(F.coalesce(F.col("action") != "purged", F.lit(False))).groupBy("queue", "action").agg(F.count("*").alias("n"))


def subscribed(messages: DataFrame, queue: str | None = None, kind: str | None = None) -> DataFrame:
    """The messages that a subscriber of a queue, or of a type, gets; works on streams too."""
    if queue is not None:
        messages = messages.where(F.col("queue") == queue)
    return messages.where(F.col("type") == kind) if kind is not None else messages


def broker_status(messages: DataFrame) -> DataFrame:
    return messages.agg(F.count("*").alias("messages"), F.countDistinct("queue").alias("queues"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.count_if(F.col("queue").isNull()).alias("unrouted"))


# agents
def assigned(steps: DataFrame, agents: DataFrame) -> DataFrame:
    """Pending steps with their agent, running; those without one stay pending."""
    waiting = steps.where("status = 'pending'")
    got = available(agents, waiting.withColumnRenamed("step_id", "task_id").select("task_id", "role")).select(F.col("task_id").alias("step_id"), "agent_id")
    return waiting.join(got, "step_id", "left").withColumn("status", F.when(F.col("agent_id").isNotNull(), "running").otherwise("pending"))


def agent_counts(agents: DataFrame) -> DataFrame:
    return agents.agg(F.count("*").alias("total"), F.count_if(F.col("status") != "offline").alias("online"), F.count_if(F.col("status") == "busy").alias("busy"))


def agent_utilisation(agents: DataFrame) -> DataFrame:
    """Per agent: whether it is in use, its queue, errors per job (of at least one), and its load."""
    return agents.select("agent_id", "role", F.when(F.col("status") == "busy", 1.0).otherwise(0.0).alias("utilisation"), "queue_length", F.round(F.col("error_count") / F.greatest(F.lit(1), "jobs"), 6).alias("error_rate"))


def workflow_counts(workflows: DataFrame, most: int = 10) -> DataFrame:
    """One row: workflows by status and the system's load."""
    of = lambda s: F.count_if(F.col("status") == s)
    return workflows.agg(F.count("*").alias("total"), of("running").alias("running"), of("completed").alias("completed"), of("failed").alias("failed"), F.round(of("running") / most, 6).alias("load"))


def role_utilisation(ticks: DataFrame, seconds: int = 30) -> DataFrame:
    """Per role: busy and whole time of its ticks (role, busy), and their ratio."""
    busy, every = F.count_if("busy") * seconds, F.count("*") * seconds
    return ticks.groupBy("role").agg(busy.alias("busy_time"), every.alias("total_time"), F.round(ratio(F.count_if("busy"), F.count("*")), 6).alias("utilisation"))


def agent_metrics(runs: DataFrame, *by: str | Column) -> DataFrame:
    """Jobs, failures, mean seconds, success rate, per agent (and day)."""
    bad = F.count_if(~F.col("success"))
    return runs.groupBy(*by).agg(F.count("*").alias("jobs"), bad.alias("failed"), F.round(F.avg("seconds"), 6).alias("avg_seconds"), F.round(1 - bad / F.count("*"), 6).alias("success_rate"))


def response_metrics(values: DataFrame, by: str, order: list[str], keep: int = 100) -> DataFrame:
    """After each value: mean, least and greatest so far, and the mean of the last ``keep``."""
    rows = running(values, by, order, "_n", _sum="value")
    rows = rows.withColumn("mean", F.round(F.col("_sum") / F.col("_n"), 6))
    rows = recent(rows, by, "_n", keep, F.avg("value"), "recent_mean").withColumn("recent_mean", F.round("recent_mean", 6))
    return extremes(rows, by).drop("_n", "_sum")


def extremes(rows: DataFrame, by: str, chunk: int = 10_000) -> DataFrame:
    """``rows`` (numbered by ``_n``) with the least and the greatest value so far, by chunks of a group."""
    held = rows.withColumn("_chunk", F.floor((F.col("_n") - 1) / chunk))
    past = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    before = held.groupBy(by, "_chunk").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi")).select(by, "_chunk", F.min("_lo").over(past).alias("_lo"), F.max("_hi").over(past).alias("_hi"))
    own = Window.partitionBy(by, "_chunk").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    local = held.withColumns({"least": F.min("value").over(own), "greatest": F.max("value").over(own)}).join(before, [by, "_chunk"])
    return local.withColumns({"least": F.least("least", "_lo"), "greatest": F.greatest("greatest", "_hi")}).drop("_chunk", "_lo", "_hi")


def outcome_summary(results: DataFrame, by: str) -> DataFrame:
    """Per job: successes, failures, mean confidence, the methods used."""
    return results.groupBy(by).agg(F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"), F.round(F.avg("confidence"), 6).alias("confidence"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"))


def tool_outputs(rows: DataFrame, by: str, wanted: dict[str, Column]) -> DataFrame:
    """Per job what each tool gave: one column per name, a count of the rows that its condition holds for."""
    return rows.groupBy(by).agg(*(F.count_if(c).alias(k) for k, c in wanted.items()))


# workflows
def extraction_steps(workflows: DataFrame) -> DataFrame:
    """Steps of each workflow (workflow_id, include_pdf, include_vision): id, role, dependencies, status pending.
    The validation waits for all extractions that there are."""
    named = lambda step: F.concat(F.col("workflow_id"), F.lit("_"), step)
    rows = []
    for step, role, needs, option in STEPS:
        asked = F.col(option) if option else F.lit(True)
        more = F.array_compact(F.array(F.when(F.col("include_pdf"), "pdf_analysis"), F.when(F.col("include_vision"), "vision_processing"))) if step == "validation" else F.array().cast("array<string>")
        deps = F.transform(F.concat(F.array(*[F.lit(x) for x in needs]).cast("array<string>"), more), named)
        rows.append(F.when(asked, F.struct(named(F.lit(step)).alias("step_id"), F.lit(role).alias("role"), deps.alias("dependencies"))))
    steps = workflows.select("workflow_id", F.explode(F.array_compact(F.array(*rows))).alias("s"))
    return steps.select("workflow_id", "s.step_id", "s.role", "s.dependencies", F.lit("pending").alias("status"))


CONFIG = "struct<steps:array<struct<step_id:string,agent_role:string,dependencies:array<string>,priority:int>>>"


def custom_steps(configs: DataFrame) -> DataFrame:
    """Steps of workflows that JSON describes (workflow_id, config); a malformed one has none."""
    return configs.select("workflow_id", F.explode(F.from_json("config", CONFIG)["steps"]).alias("s")).select("workflow_id", "s.step_id", F.col("s.agent_role").alias("role"), F.coalesce("s.dependencies", F.array().cast("array<string>")).alias("dependencies"), F.coalesce("s.priority", F.lit(5)).alias("priority"))


def cancelled(steps: DataFrame, workflow: str) -> DataFrame:
    """The steps after a workflow is cancelled: its running and pending ones are."""
    hit = (F.col("workflow_id") == workflow) & F.col("status").isin("running", "pending")
    return steps.withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status")))


def completed_by(steps: DataFrame, messages: DataFrame) -> DataFrame:
    """The steps after messages (job_id) that tell of their completion."""
    done = messages.select(F.col("job_id").alias("step_id")).distinct().withColumn("_done", F.lit(True))
    return steps.join(done, "step_id", "left").withColumn("status", F.when(F.col("_done"), "completed").otherwise(F.col("status"))).drop("_done")
