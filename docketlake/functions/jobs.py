"""Plans, durations, recovery and advice of extraction jobs. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlake import dictionaries as D
from docketlake.functions.assess import flag, listed, n


def lookup(values: dict, key: Column, default) -> Column:
    held = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(held, key), F.lit(default))


def stages_by_site(is_complex: Column, image_heavy: Column, validated: Column) -> Column:
    return listed((F.lit(True), "analysis"), (F.lit(True), "html_extraction"), (is_complex, "pdf_analysis"), (image_heavy, "vision_processing"), (F.coalesce(validated, F.lit(True)), "validation"))


def stages_by_strategy(strategy: Column) -> Column:
    has = lambda x: F.array_contains(strategy, x)
    return listed((F.lit(True), "discovery"), (has("html_parsing"), "html_extraction"), (has("pdf_extraction"), "pdf_analysis"), (has("computer_vision"), "vision_processing"), (F.lit(True), "validation"))


def plan_duration(stages: Column, base: float) -> Column:
    """``base`` for each stage, times its weight; whole units."""
    return F.aggregate(stages, F.lit(0.0), lambda a, s: a + base * lookup(D.STAGE_WEIGHTS, s, 1.0)).cast("int")


def plan_needs(stages: Column) -> Column:
    has = lambda x: F.array_contains(stages, x)
    return F.struct((has("pdf_analysis") | has("vision_processing")).alias("cpu_intensive"), (F.size(stages) > 3).alias("network_heavy"), F.when(has("vision_processing"), "high").otherwise("medium").alias("memory_usage"), (F.size(stages) > 2).alias("parallel"))


AGENT_MINUTES = {"html_parsing": 3, "pdf_extraction": 8, "vision_processing": 12}


def parallel_minutes(methods: Column) -> Column:
    """The longest of the known methods and two minutes; 0 where none is known."""
    known = F.filter(methods, lambda m: m.isin(list(AGENT_MINUTES)))
    return F.when(F.size(known) > 0, F.array_max(F.transform(known, lambda m: lookup(AGENT_MINUTES, m, 0))) + 2).otherwise(0)


def success_rate(confidence: Column, n_stages: Column) -> Column:
    s = 0.8 + (1 - confidence) * 0.2 - F.greatest(F.lit(0.0), (n_stages - 3) * 0.05)
    return F.least(F.lit(0.95), F.greatest(F.lit(0.3), s))


def recovery(kind: Column, stage: Column, retries: Column, most: Column) -> Column:
    """Action, what to do instead, and its minutes."""
    left = n(retries) < F.coalesce(most, F.lit(3))
    analysis, extraction, late = (stage == "analysis") & left, (stage == "extraction") & left, kind == "timeout"

    def pick(a, b, c, d):
        return F.when(flag(analysis), a).when(flag(extraction), b).when(flag(late), c).otherwise(d)

    other = F.when(kind.contains("html"), "pdf_extraction").otherwise("html_extraction")
    action = pick("retry_with_fallback", "switch_method", "reduce_scope", "fail")
    return F.struct(action.alias("action"), pick("basic_html_extraction", other, "sample_extraction", F.lit(None).cast("string")).alias("alternative"), pick(5, 10, 3, 0).alias("minutes"), (action != "fail").alias("retry"), F.when(action != "fail", 0.8).otherwise(0.2).alias("confidence"))


def error_action(stage: Column, retries: Column, most: Column) -> Column:
    """retry ▸ fallback (discovery) ▸ other method (extraction) ▸ fail."""
    return F.when(n(retries) < F.coalesce(most, F.lit(3)), "retry").when(stage == "discovery", "fallback").when(stage == "extraction", "switch_method").otherwise("job_failed")


def next_stage(status: Column, stage: Column, n_stages: Column, retries: Column, most: Column) -> Column:
    """The job's stage, retries and whether it is archived, after a status."""
    done, failed = status == "completed", status == "failed"
    forward = F.when(done & (stage < n_stages - 1), stage + 1).otherwise(stage)
    again = failed & (retries < most)
    return F.struct(F.when(again, F.greatest(F.lit(0), stage - 1)).otherwise(forward).alias("stage"), F.when(again, retries + 1).otherwise(retries).alias("retries"), ((done & (forward >= n_stages - 1)) | (failed & ~again)).alias("archived"))


def workflow_advice(success: Column, seconds: Column, utilisation: Column) -> Column:
    return listed((utilisation > 0.9, "scale agents"), (utilisation < 0.3, "reduce agents"), (seconds > 300, "parallelise stages"), (success < 0.8, "review failures"))


def performance_advice(success: Column, minutes: Column, utilisations: Column) -> Column:
    """Advice by success, time and each agent's use (array of (agent, utilisation)); health is good below three."""
    fixed = listed((success < 0.8, "Improve error handling and recovery strategies"), (success < 0.6, "Review agent selection and handoff decisions"), (minutes > 30, "Consider more parallel processing opportunities"), (minutes > 60, "Implement workflow timeout and progressive fallback"))
    used = F.array_compact(F.transform(utilisations, lambda u: F.when(u["utilisation"] > 0.9, F.concat(F.lit("Consider scaling "), u["agent"], F.lit(" - high utilization detected"))).when(u["utilisation"] < 0.2, F.concat(F.lit("Review "), u["agent"], F.lit(" usage - low utilization detected")))))
    every = F.concat(fixed, used)
    return F.struct(every.alias("advice"), F.when(F.size(every) < 3, "good").otherwise("needs_improvement").alias("health"))
