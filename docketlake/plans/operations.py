"""Queries of the broker, the cache, the coordinator and the records, each with its SQL.

Events stand for messages and uses, parts for cache entries, line items for steps, users for agents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docketlake.functions import jobs as J
from docketlake.functions import registry as G
from docketlake.functions import validate as V
from docketlake.operators import cache as C
from docketlake.operators import coordination as O
from docketlake.operators import records as R
from docketlake.operators import workflow as K
from docketlake.plans.catalogue import documents, failed, parties, query
from docketlake.plans.catalogue import PARTIES
from docketlake.sources.tables import read

ROUTES = {"view": "orchestrator", "click": "validation", "error": "orchestrator", "purchase": "validation"}
SQL_QUEUE = "CASE event_type WHEN 'view' THEN 'orchestrator' WHEN 'click' THEN 'validation' WHEN 'error' THEN 'orchestrator' WHEN 'purchase' THEN 'validation' END"


def queue_of(kind="event_type"):
    return K.route(F.col(kind), F.lit(None).cast("string"), [], ROUTES)


def messages(spark, d):
    return read(spark, d, "events").select(F.col("event_id").alias("message_id"), "ts", F.col("event_type").alias("type"), F.col("user_id").alias("sender"), "value", queue_of().alias("queue"))


@query(f"""WITH d AS (SELECT event_id AS message_id, ts, {SQL_QUEUE} AS queue, row_number() OVER (ORDER BY ts, event_id) AS n FROM events WHERE value < 5), l AS (SELECT * FROM d WHERE n <= 100)
    SELECT message_id, queue, n::INT AS n FROM l WHERE n < coalesce((SELECT min(n) FROM l WHERE queue IS NULL), 1000)""")
def dead_letters_requeued(spark, d):
    """Dead letters (the messages of little value) that go back to a queue, up to the first that can't."""
    dead = messages(spark, d).where("value < 5").drop("queue")
    return O.requeued(dead, queue_of("type")).select("message_id", "queue", "n")


@query(f"SELECT {SQL_QUEUE} AS queue, count(*) AS n, (SELECT count(*) FROM events WHERE {SQL_QUEUE} = 'validation') AS purged FROM events WHERE coalesce({SQL_QUEUE} <> 'validation', true) GROUP BY 1")
def queue_purged(spark, d):
    """Sizes of the queues after one was cleared, and how many messages went."""
    left, gone = O.purged(messages(spark, d), "validation")
    return left.groupBy("queue").agg(F.count("*").alias("n")).withColumn("purged", gone.select("purged").scalar())


@query(f"SELECT {SQL_QUEUE} AS queue, CASE WHEN value > 60 THEN 'processed' WHEN value > 5 THEN 'queued' ELSE 'failed' END AS action, count(*) AS n FROM events WHERE value <= 90 GROUP BY 1, 2")
def queue_counters(spark, d):
    action = F.when(F.col("value") > 90, "purged").when(F.col("value") > 60, "processed").when(F.col("value") > 5, "queued").otherwise("failed")
    return O.counters(messages(spark, d).withColumn("action", action))


@query(f"SELECT count(*) AS messages, count(DISTINCT {SQL_QUEUE}) AS queues, min(ts) AS oldest, max(ts) AS newest, count(*) FILTER ({SQL_QUEUE} IS NULL) AS unrouted FROM events")
def broker_status(spark, d):
    return O.broker_status(messages(spark, d))


@query(f"SELECT event_id AS message_id, 'queue' AS via FROM events WHERE {SQL_QUEUE} = 'orchestrator' UNION ALL SELECT event_id, 'type' FROM events WHERE event_type = 'error'")
def subscriptions(spark, d):
    """What the subscribers of a queue and of a type get."""
    m = messages(spark, d)
    return O.subscribed(m, queue="orchestrator").select("message_id", F.lit("queue").alias("via")).unionByName(O.subscribed(m, kind="error").select("message_id", F.lit("type").alias("via")))


@query("SELECT user_id AS sender, max(ts) AS last_heartbeat, arg_max(value, (ts, event_id)) AS metric, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'offline' ELSE 'idle' END AS status FROM events GROUP BY 1")
def agent_health(spark, d):
    """Each agent's last beat and metric; one that reports again is idle."""
    last = F.max_by(F.struct("value", "type"), F.struct("ts", "message_id"))
    m = messages(spark, d).groupBy("sender").agg(F.max("ts").alias("last_heartbeat"), last.alias("l"))
    return m.select("sender", "last_heartbeat", F.col("l.value").alias("metric"), F.when(F.col("l.type") == "error", "offline").otherwise("idle").alias("status"))


# cache
def tiers(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal", F.when(F.col("c_nationkey") == 0, F.lit("2000-01-01").cast("timestamp")).alias("expires_at"))
    return {"local": c.where("c_acctbal > 5000"), "shared": c.where("c_acctbal > 0"), "file": c.where("c_acctbal > -500")}


SQL_TIER = "CASE WHEN c_nationkey = 0 THEN NULL WHEN c_acctbal > 5000 THEN 'local' WHEN c_acctbal > 0 THEN 'shared' WHEN c_acctbal > -500 THEN 'file' END"


@query(f"SELECT o_orderkey, {SQL_TIER} AS tier FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def cache_lookup(spark, d):
    """Orders ask for their customer's entry; entries of one nation have expired."""
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    return C.lookup(o, tiers(spark, d), F.lit("2024-01-01").cast("timestamp")).select("o_orderkey", "tier")


@query(f"SELECT count(t) AS hits, count(*) - count(t) AS misses, round(count(t)::DOUBLE / count(*), 6) AS hit_rate FROM (SELECT {SQL_TIER} AS t FROM orders LEFT JOIN customer ON o_custkey = c_custkey)")
def cache_statistics(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("key"))
    return C.statistics(C.lookup(o, tiers(spark, d), F.lit("2024-01-01").cast("timestamp")))


def entries(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("store"), F.col("p_retailprice").cast("long").alias("size"), F.col("p_partkey").alias("created_at"), F.when(F.col("p_retailprice") > 1200, -F.col("p_partkey")).alias("last_accessed"))


SQL_ENTRIES = "(SELECT p_partkey AS key, p_brand AS store, trunc(p_retailprice)::BIGINT AS size, coalesce(CASE WHEN p_retailprice > 1200 THEN -p_partkey END, p_partkey) AS used FROM part)"


@query(f"""WITH f AS (SELECT store, key FROM (SELECT *, sum(size) OVER (PARTITION BY store ORDER BY used DESC, key DESC ROWS UNBOUNDED PRECEDING) AS held FROM {SQL_ENTRIES}) WHERE held <= 50000)
    SELECT e.store, count(f.key) AS kept, count(*) AS n, arg_min(e.key, (e.used, e.key)) AS first_out FROM {SQL_ENTRIES} e LEFT JOIN f ON e.store = f.store AND e.key = f.key GROUP BY e.store""")
def cache_evictions(spark, d):
    """Per store the entries that stay within the budget, and the one that goes first."""
    e = entries(spark, d)
    kept = C.fitting(e, "store", 50_000).groupBy("store").agg(F.count("*").alias("kept"))
    return e.groupBy("store").agg(F.count("*").alias("n")).join(kept, "store", "left").join(C.least_recent(e, "store").withColumnRenamed("key", "first_out"), "store").select("store", F.coalesce("kept", F.lit(0)).alias("kept"), "n", "first_out")


@query("SELECT p_brand AS kind, count(*) AS n FROM part WHERE NOT starts_with(p_name, 'part 1') AND p_size <> 7 AND p_partkey NOT IN (SELECT ps FROM (SELECT l_partkey AS ps FROM lineitem WHERE l_quantity = 50)) GROUP BY 1")
def cache_invalidations(spark, d):
    """Entries left after invalidation by pattern, by dependency and by key."""
    p = read(spark, d, "part").select("p_partkey", F.col("p_name").alias("key"), F.col("p_brand").alias("kind"), F.array(F.concat(F.lit("size"), F.col("p_size").cast("string"))).alias("dependencies"))
    left = C.without_dependents(C.without_matches(p, "part 1*"), "size7").withColumn("key", F.col("p_partkey"))
    return C.without_keys(left, read(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("key"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, substring(sha256('{"lang":"' || lang || '","source":"' || source || '"}'), 1, 16) AS signature, md5(source || ':' || lang) AS content_key FROM documents""")
def request_signatures(spark, d):
    return documents(spark, d).select("doc_id", C.signature(F.col("lang"), F.col("source"), length=16).alias("signature"), C.content_key(F.col("source"), F.col("lang")).alias("content_key"))


@query("SELECT doc_id, lang || ':' || source AS signature, upper(lang || ':' || source) AS answer FROM documents")
def requests_run_once(spark, d):
    """Equal requests share one run, whose answers come back to all."""
    rows = documents(spark, d).select("doc_id", F.concat_ws(":", "lang", "source").alias("signature"))
    return C.shared_requests(rows, "signature", lambda s: s.withColumn("answer", F.upper("signature"))).select("doc_id", "signature", "answer")


@query("SELECT o_orderkey, o_custkey AS key, coalesce(c_mktsegment, 'run') AS answer, c_mktsegment IS NOT NULL AS cached FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def cached_or_run(spark, d):
    """Answers of the cache, and of a run for the keys that it lacks."""
    cached = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("answer"))
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    return C.cached_or_run(o, cached, lambda k: k.withColumn("answer", F.lit("run"))).select("o_orderkey", "key", "answer", "cached")


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5 AS batch FROM documents")
def batch_numbers(spark, d):
    return C.batches(documents(spark, d).select("doc_id", "source"), "source", ["doc_id"], 5)


@query("""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, n AS number, count(*) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts, event_id) - 1) // 4 AS n FROM events) GROUP BY ALL""")
def batch_flushes(spark, d):
    """Batches flushed after an hour, or at four events."""
    return C.flushes(read(spark, d, "events"), "event_type", 4, 3600)


@query("""SELECT doc_id, CASE WHEN length(text) > 5000 THEN 'file' WHEN length(text) < 1000 THEN 'local' ELSE 'shared' END AS tier, length(text) > 1024 AND length(replace(text, 'e', '')) <= 0.9 * length(text) AS packed, CASE lang WHEN 'en' THEN 86400 WHEN 'de' THEN 604800 ELSE 3600 END::BIGINT AS ttl FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)""")
def cache_storage(spark, d):
    """Where an entry goes, whether it is packed, and how long it lives."""
    t = F.col("text")
    rows = documents(spark, d).select("doc_id", C.storage(F.length(t), F.length(F.replace(t, F.lit("e"), F.lit(""))), 5000, 10_000).alias("s"), "lang", F.lit("2024-01-01").cast("timestamp").alias("at"))
    rows = C.with_expiry(rows, "lang", "at", {"en": 86_400, "de": 604_800})
    return rows.select("doc_id", "s.tier", "s.packed", R.seconds_between(F.col("at"), F.col("expires_at")).alias("ttl"))


# coordinator
SQL_AGENTS = "(SELECT user_id AS agent_id, arg_max(event_type, (ts, event_id)) AS role, CASE WHEN avg(value) > 50 THEN 'busy' WHEN avg(value) > 20 THEN 'idle' ELSE 'offline' END AS status, count(*) AS queue_length, count(*) FILTER (event_type = 'error') AS error_count, count(*) FILTER (event_type <> 'error') AS jobs FROM events GROUP BY 1)"


def agents(spark, d):
    e = read(spark, d, "events")
    mean = F.avg("value")
    return e.groupBy(F.col("user_id").alias("agent_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("role"), F.when(mean > 50, "busy").when(mean > 20, "idle").otherwise("offline").alias("status"), F.count("*").alias("queue_length"), F.count_if(failed()).alias("error_count"), F.count_if(~failed()).alias("jobs"))


@query(f"SELECT agent_id, role, CASE WHEN status = 'busy' THEN 1.0 ELSE 0.0 END::DOUBLE AS utilisation, queue_length, round(error_count::DOUBLE / greatest(1, jobs), 6) AS error_rate FROM {SQL_AGENTS}")
def agent_utilisation(spark, d):
    return O.agent_utilisation(agents(spark, d))


@query(f"SELECT count(*) AS total, count(*) FILTER (status <> 'offline') AS online, count(*) FILTER (status = 'busy') AS busy FROM {SQL_AGENTS}")
def agent_counts(spark, d):
    return O.agent_counts(agents(spark, d))


@query(f"""SELECT t.event_id AS task_id, arg_min(a.agent_id, (a.queue_length, a.error_count, a.agent_id)) AS agent_id FROM events t JOIN {SQL_AGENTS} a ON a.role = t.event_type AND a.status = 'idle' GROUP BY 1""")
def available_agents(spark, d):
    """The best idle agent of each task's role."""
    tasks = read(spark, d, "events").select(F.col("event_id").alias("task_id"), F.col("event_type").alias("role"))
    return O.available(agents(spark, d), tasks).select("task_id", "agent_id")


@query(f"""WITH b AS (SELECT role, arg_min(agent_id, (queue_length, error_count, agent_id)) AS agent_id FROM {SQL_AGENTS} WHERE status = 'idle' AND role <> 'click' GROUP BY role)
    SELECT event_id AS step_id, coalesce(agent_id, -1) AS agent_id, CASE WHEN agent_id IS NULL THEN 'pending' ELSE 'running' END AS status FROM events LEFT JOIN b ON role = event_type WHERE value < 50""")
def assigned_steps(spark, d):
    """Pending steps get an agent and run; one role has none."""
    steps = read(spark, d, "events").select(F.col("event_id").alias("step_id"), F.col("event_type").alias("role"), F.when(F.col("value") < 50, "pending").otherwise("completed").alias("status"))
    return O.assigned(steps, agents(spark, d).where("role <> 'click'")).select("step_id", F.coalesce("agent_id", F.lit(-1)).alias("agent_id"), "status")


WORKFLOWS = "(SELECT CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status FROM orders)"


@query(f"SELECT count(*) AS total, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, round(count(*) FILTER (status = 'running') / 10.0::DOUBLE, 6) AS load FROM {WORKFLOWS}")
def workflow_counts(spark, d):
    return O.workflow_counts(read(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed").alias("status")))


@query("SELECT event_type AS role, count(*) FILTER (value > 50) * 30 AS busy_time, count(*) * 30 AS total_time, round(count(*) FILTER (value > 50)::DOUBLE / count(*), 6) AS utilisation FROM events GROUP BY 1")
def role_utilisation(spark, d):
    return O.role_utilisation(read(spark, d, "events").select(F.col("event_type").alias("role"), (F.col("value") > 50).alias("busy")))


@query("SELECT user_id AS agent_id, ts::DATE::VARCHAR AS metric_date, count(*) AS jobs, count(*) FILTER (event_type = 'error') AS failed, round(avg(value), 6) AS avg_seconds, round(1 - count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 6) AS success_rate FROM events GROUP BY 1, 2")
def agent_daily_metrics(spark, d):
    runs = read(spark, d, "events").select(F.col("user_id").alias("agent_id"), F.to_date("ts").cast("string").alias("metric_date"), (~failed()).alias("success"), F.col("value").alias("seconds"))
    return O.agent_metrics(runs, "agent_id", "metric_date")


@query("""SELECT event_id, round(avg(value) OVER w, 6) AS mean, min(value) OVER w AS least, max(value) OVER w AS greatest, round(avg(value) OVER r, 6) AS recent_mean FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), r AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 99 PRECEDING)""")
def response_metrics(spark, d):
    return O.response_metrics(read(spark, d, "events"), "event_type", ["ts", "event_id"]).select("event_id", "mean", "least", "greatest", "recent_mean")


@query("SELECT user_id AS job_id, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed, round(avg(value), 6) AS confidence, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS methods FROM events GROUP BY 1")
def outcome_summary(spark, d):
    rows = read(spark, d, "events").select(F.col("user_id").alias("job_id"), (~failed()).alias("success"), F.col("value").alias("confidence"), F.col("event_type").alias("method"))
    return O.outcome_summary(rows, "job_id")


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS asked, count(*) FILTER (role = 'assistant') AS answered, count(*) FILTER (length(text) > 500) AS long FROM conversations GROUP BY 1")
def tool_outputs(spark, d):
    return O.tool_outputs(read(spark, d, "conversations"), "conv_id", {"asked": F.col("role") == "user", "answered": F.col("role") == "assistant", "long": F.length("text") > 500})


@query("""WITH w AS (SELECT 'w' || o_orderkey AS w, o_orderstatus = 'O' AS pdf, o_totalprice > 200000 AS vision FROM orders),
    s AS (SELECT w, pdf, vision, unnest(['discovery', 'orchestration', 'html_extraction', 'pdf_analysis', 'vision_processing', 'validation']) AS step FROM w)
    SELECT w AS workflow_id, w || '_' || step AS step_id, CASE step WHEN 'discovery' THEN 'discovery' WHEN 'orchestration' THEN 'orchestrator' WHEN 'html_extraction' THEN 'html_extractor' WHEN 'pdf_analysis' THEN 'pdf_analyzer' WHEN 'vision_processing' THEN 'vision_processor' ELSE 'content_validator' END AS role,
    CASE step WHEN 'discovery' THEN '' WHEN 'orchestration' THEN w || '_discovery' WHEN 'validation' THEN w || '_html_extraction' || CASE WHEN pdf THEN ',' || w || '_pdf_analysis' ELSE '' END || CASE WHEN vision THEN ',' || w || '_vision_processing' ELSE '' END ELSE w || '_orchestration' END AS dependencies
    FROM s WHERE NOT (step = 'pdf_analysis' AND NOT pdf) AND NOT (step = 'vision_processing' AND NOT vision)""")
def extraction_steps(spark, d):
    """The steps of an extraction for every order."""
    w = read(spark, d, "orders").select(F.concat(F.lit("w"), F.col("o_orderkey").cast("string")).alias("workflow_id"), (F.col("o_orderstatus") == "O").alias("include_pdf"), (F.col("o_totalprice") > 200_000).alias("include_vision"))
    return O.extraction_steps(w).select("workflow_id", "step_id", "role", F.array_join("dependencies", ",").alias("dependencies"))


@query("""SELECT user_id, array_to_string(list_filter([CASE WHEN s < 0.8 THEN 'Improve error handling and recovery strategies' END, CASE WHEN s < 0.6 THEN 'Review agent selection and handoff decisions' END, CASE WHEN m > 30 THEN 'Consider more parallel processing opportunities' END, CASE WHEN m > 60 THEN 'Implement workflow timeout and progressive fallback' END,
    CASE WHEN s > 0.9 THEN 'Consider scaling a - high utilization detected' WHEN s < 0.2 THEN 'Review a usage - low utilization detected' END], lambda x: x IS NOT NULL), ';') AS advice, array_to_string(list_filter([CASE WHEN s > 0.9 THEN 'scale agents' END, CASE WHEN s < 0.3 THEN 'reduce agents' END, CASE WHEN m * 10 > 300 THEN 'parallelise stages' END, CASE WHEN s < 0.8 THEN 'review failures' END], lambda x: x IS NOT NULL), ';') AS workflow
    FROM (SELECT user_id, round(count(*) FILTER (event_type <> 'error')::DOUBLE / count(*), 6) AS s, round(avg(value), 6) AS m FROM events GROUP BY 1)""")
def performance_advice(spark, d):
    s, m = F.col("s"), F.col("m")
    rows = read(spark, d, "events").groupBy("user_id").agg(F.round(F.count_if(~failed()) / F.count("*"), 6).alias("s"), F.round(F.avg("value"), 6).alias("m"))
    advice = J.performance_advice(s, m, F.array(F.struct(F.lit("a").alias("agent"), s.alias("utilisation"))))
    return rows.select("user_id", F.array_join(advice["advice"], ";").alias("advice"), F.array_join(J.workflow_advice(s, m * 10, s), ";").alias("workflow"))


@query("SELECT l_orderkey AS workflow_id, l_linenumber AS step_id, CASE WHEN l_orderkey = 1 AND l_linestatus <> 'F' THEN 'cancelled' WHEN l_linestatus = 'F' THEN 'completed' ELSE 'running' END AS status FROM lineitem")
def cancelled_steps(spark, d):
    s = read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("workflow_id"), F.col("l_linenumber").alias("step_id"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("running").alias("status"))
    return O.cancelled(s, "1").withColumn("workflow_id", F.col("workflow_id").cast("long"))


@query("SELECT o_orderkey AS step_id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'completed' ELSE 'running' END AS status FROM orders")
def completed_steps(spark, d):
    steps = read(spark, d, "orders").select(F.col("o_orderkey").alias("step_id"), F.lit("running").alias("status"))
    return O.completed_by(steps, read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job_id"))).select("step_id", "status")


# records
@query("""SELECT p_partkey, CASE WHEN p_size > 10 THEN p_brand || ': ' || p_name ELSE p_name END AS title, CASE WHEN contains(lower(p_name), 'regulation') THEN 'regulation' WHEN contains(lower(p_name), 'act') THEN 'act' WHEN contains(lower(p_name), 'bill') THEN 'bill' WHEN contains(lower(p_name), 'directive') THEN 'directive' ELSE coalesce(nullif(CASE WHEN p_size > 25 THEN 'bill' ELSE '' END, ''), 'other') END AS kind,
    array_to_string(list_sort(list_distinct(list_filter([trim(p_brand), trim(p_name), trim(p_brand), 'xy'], lambda x: length(x) BETWEEN 3 AND 200))), ',') AS ids, p_size < 20 AS expired FROM part""")
def record_titles(spark, d):
    """Titles with their id, types by title and hint, distinct ids, expiry."""
    p = read(spark, d, "part")
    ids = R.trimmed_distinct(F.array("p_brand", "p_name", "p_brand", F.lit("xy")))
    return p.select("p_partkey", R.display_title(F.when(F.col("p_size") > 10, F.col("p_brand")), F.col("p_name")).alias("title"), R.title_type(F.col("p_name"), F.when(F.col("p_size") > 25, "bill").otherwise("")).alias("kind"), F.array_join(F.array_sort(ids), ",").alias("ids"), R.expired(F.col("p_size"), F.lit(20)).alias("expired"))


@query("""SELECT o_orderkey, CASE WHEN DATE '1997-01-01' >= o_orderdate::DATE + 900 THEN 'expired' WHEN DATE '1997-01-01' >= (CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE + 30 ELSE o_orderdate::DATE END) THEN 'in_force' ELSE 'not_yet_in_force' END AS status FROM orders""")
def order_validity(spark, d):
    """Publication, effect (for some) and expiry as typed dates; the status on a day."""
    at = F.to_date("o_orderdate")
    entry = lambda kind, day: F.struct(F.lit(kind).alias("kind"), day.alias("date"))
    dates = F.array_compact(F.array(entry("publication", at), F.when(F.col("o_orderstatus") == "F", entry("effective", F.date_add(at, 30))), entry("expiry", F.date_add(at, 900))))
    return read(spark, d, "orders").select("o_orderkey", R.current_status(dates, F.lit("1997-01-01").cast("date")).alias("status"))


@query(f"SELECT count(DISTINCT jurisdiction) AS jurisdictions, count(DISTINCT agency) AS agencies, count(*) AS total FROM {PARTIES}")
def distinct_places(spark, d):
    return R.distinct_places(parties(spark, d))


@query("SELECT event_id, (epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01'))::BIGINT AS seconds FROM events")
def event_seconds(spark, d):
    return read(spark, d, "events").select("event_id", R.seconds_between(F.lit("2024-01-01").cast("timestamp"), F.col("ts")).alias("seconds"))


@query("SELECT s_suppkey AS source_id, s_name AS name FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def newest_sources(spark, d):
    """Ten sources (the listing's number)."""
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("discovered_date"))
    return R.newest_sources(s).select("source_id", "name")


@query("""WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'error'), u AS (SELECT event_type, count(*) AS n, sum(value) AS items FROM r WHERE n <= 10 GROUP BY 1),
    p AS (SELECT event_type, round(avg(value) / 200, 6) AS confidence, round(avg(value), 6) AS avg_items, count(*) FILTER (value > 20)::DOUBLE / count(*) AS rate FROM events GROUP BY 1)
    SELECT p.event_type AS pattern_id, round(CASE WHEN u.n > 0 THEN least(1.0::DOUBLE, confidence + least(0.1::DOUBLE, 0.01::DOUBLE * items / n)) ELSE confidence END, 6) AS confidence, round(CASE WHEN u.n > 0 THEN (avg_items + items / n) / 2 ELSE avg_items END, 6) AS avg_items,
    round(0.6::DOUBLE * rate + 0.2::DOUBLE * (coalesce(n, 0) / 100.0::DOUBLE) + 0.2::DOUBLE * (coalesce(items / n, 0) / 10), 6) AS score, coalesce(rate < 0.3 AND n > 5, false) AS deprecated FROM p LEFT JOIN u ON p.event_type = u.event_type""")
def optimised_patterns(spark, d):
    """Patterns after the last ten successful uses of every source."""
    e = read(spark, d, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    uses = e.where(~failed()).withColumn("n", place).where("n <= 10").groupBy(F.col("event_type").alias("pattern_id")).agg(F.count("*").alias("n"), F.sum("value").alias("items"))
    patterns = e.groupBy(F.col("event_type").alias("pattern_id")).agg(F.round(F.avg("value") / 200, 6).alias("confidence"), F.round(F.avg("value"), 6).alias("avg_items"), (F.count_if(F.col("value") > 20) / F.count("*")).alias("success_rate"))
    return R.optimised(patterns, uses)


@query("""SELECT page_id FROM (SELECT *, row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) AS n FROM pages) WHERE n <= 10 AND length(html) > 2000 AND regexp_matches(url, '^https?://[^/?#\\s]+')""")
def drilled_pages(spark, d):
    """Of each group's first ten pages (the operator's number) the long ones with an address."""
    p = read(spark, d, "pages").select("page_id", "url", (F.col("page_id") % 7).alias("listing"), (F.length("html") > 2000).alias("needs_drill_down"))
    return R.drill_down(p, "listing", "page_id").select("page_id")


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents))
    SELECT doc_id, len(list_filter(ls, lambda x: len(regexp_split_to_array(x, '\s+')) >= 3))::INT AS table_rows, len(list_filter(ls, lambda x: contains(x, ':') AND length(split_part(x, ':', 1)) < 50 AND trim(regexp_replace(x, '^[^:]*:', '')) <> ''))::INT AS fields,
    len(list_filter(ls, lambda x: regexp_matches(x, '^(?:[•·*-]|[0-9]+[.)])\s*')))::INT AS items FROM l""")
def text_layout(spark, d):
    return documents(spark, d).select("doc_id", R.text_layout(F.col("text")).alias("x")).select("doc_id", "x.table_rows", "x.fields", "x.items")


@query("SELECT substring(md5(s_name || '_' || s_address_or), 1, 12) AS target_id, s_suppkey FROM (SELECT s_suppkey, s_name, s_suppkey::VARCHAR AS s_address_or FROM supplier)")
def target_ids(spark, d):
    s = read(spark, d, "supplier")
    return s.select(R.target_id(F.col("s_name"), F.col("s_suppkey").cast("string")).alias("target_id"), "s_suppkey")


# lookups, states and reports
@query("SELECT o_orderkey, coalesce(c_mktsegment, 'unknown') AS segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def looked_up_segments(spark, d):
    """The customer's segment of each order; unknown where the customer is not listed."""
    c = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return R.looked_up(read(spark, d, "orders"), c, "o_custkey", "segment").select("o_orderkey", "segment")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def named_customers(spark, d):
    ids = read(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return R.named_only(read(spark, d, "customer"), ids, "c_custkey").select("c_custkey")


@query("SELECT p_partkey AS pattern_id, p_size + (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS success_count FROM part")
def reinforced_patterns(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("pattern_id"), F.col("p_size").cast("long").alias("success_count"))
    return R.reinforced_patterns(p, read(spark, d, "lineitem").select(F.col("l_partkey").alias("pattern_id")))


@query("""SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'error') WHERE n <= 5 AND value >= 5 AND value / 2 < 30""")
def fast_sessions(spark, d):
    s = read(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("source_id"), (~failed()).alias("success"), F.col("value").alias("items"), (F.col("value") / 2).alias("seconds"))
    return R.fast_sessions(s, "source_id", ["ts", "event_id"]).select("event_id")


@query("SELECT lower(r_name) || '_' || 'region_' || ((SELECT count(*) FROM supplier) + row_number() OVER (ORDER BY r_name) - 1) AS source_id, r_name AS name, 1.0::DOUBLE AS confidence FROM region")
def manual_sources(spark, d):
    rows = read(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_name").alias("agency"), F.lit("region").alias("source_type"))
    return R.manual_sources(rows, read(spark, d, "supplier")).select("source_id", "name", "confidence")


@query("SELECT source, round(count(*) FILTER (coalesce(text, '') <> '' AND coalesce(lang, '') <> '')::DOUBLE / count(*), 6) AS success_rate, max(doc_id) AS last_checked FROM documents GROUP BY source")
def validated_sources(spark, d):
    items = read(spark, d, "documents").select("source", F.col("text").alias("title"), F.col("lang").alias("url"), F.col("doc_id").alias("discovered_date"))
    return R.validated_source(items, "source")


@query("""SELECT d.doc_id AS item_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality::DOUBLE ELSE 0.5 END AS relevance_score, CASE WHEN l.toxic = 1 THEN 'news' ELSE d.lang END AS item_type, CASE WHEN l.doc_id IS NOT NULL THEN 'processed' ELSE 'new' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def analysed_items(spark, d):
    """Labels come in as replies of an analysis."""
    items = read(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.lit(0.5).alias("relevance_score"), F.col("lang").alias("item_type"), F.lit("new").alias("status"))
    replies = read(spark, d, "labels").select(F.col("doc_id").alias("item_id"), F.to_json(F.struct(F.col("quality").cast("double").alias("relevance"), F.when(F.col("toxic") == 1, "news").alias("item_type"))).alias("reply"))
    return R.analysed(items, replies).select("item_id", "relevance_score", "item_type", "status")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS updated_at FROM customer")
def touched_rows(spark, d):
    """Rows that an update changed (negative balances set to 0) get the new time."""
    before = read(spark, d, "customer").select("c_custkey", "c_acctbal", F.lit(1).alias("updated_at"))
    after = before.withColumn("c_acctbal", F.greatest("c_acctbal", F.lit(0.0)))
    return R.touched(before, after, "c_custkey", F.lit(2)).select("c_custkey", "updated_at")


@query("""WITH w AS (SELECT unnest(['view', 'signup', 'refund', 'critical']) AS event_type) SELECT w.event_type, count(e.event_id) AS n FROM w LEFT JOIN events e ON w.event_type = e.event_type GROUP BY 1""")
def category_counts(spark, d):
    return R.category_counts(read(spark, d, "events"), "event_type", ["view", "signup", "refund", "critical"])


@query("""SELECT conv_id, count(*) AS n_pages, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, coalesce(text, '')) AS text, round(count(*) FILTER (length(text) > 100)::DOUBLE / count(*), 6) AS success_rate, round(avg(least(1.0::DOUBLE, length(text) / 1000.0)), 6) AS confidence,
    CASE WHEN round(count(*) FILTER (length(text) > 100)::DOUBLE / count(*), 6) > 0.9 THEN 'high' WHEN round(count(*) FILTER (length(text) > 100)::DOUBLE / count(*), 6) > 0.7 THEN 'medium' ELSE 'low' END AS quality FROM conversations GROUP BY conv_id""")
def image_sequences(spark, d):
    """Turns stand for recognised pages."""
    rows = read(spark, d, "conversations").withColumns({"success": F.length("text") > 100, "confidence": F.least(F.lit(1.0), F.length("text") / 1000.0)})
    return R.image_sequence(rows, "conv_id", "turn")


@query(r"""SELECT doc_id, length(text)::INT AS length, len(regexp_extract_all(text, '\S+'))::INT AS words, len(string_split(text, chr(10)))::INT AS lines, regexp_matches(lower(text), 'regulation|law|act|section|article') AS regulatory,
    'Title: ' || source || chr(10) || 'URL: ' || lang || chr(10) || chr(10) || CASE WHEN length(text) > 2000 THEN substring(text, 1, 2000) || '...' ELSE text END AS shown, ceil(length(text) / 4.0)::BIGINT AS tokens FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)""")
def document_facts(spark, d):
    """Facts of a text, the extraction shown as text (its head, which is the listing's limit), and its estimated tokens."""
    t = F.col("text")
    rows = documents(spark, d).select("doc_id", R.document_facts(t).alias("f"), R.extraction_text(F.col("source"), F.col("lang"), t).alias("shown"), G.estimated_tokens(t).alias("tokens"))
    return rows.select("doc_id", "f.length", "f.words", "f.lines", "f.regulatory", "shown", "tokens")


@query("""SELECT count(*) AS extractions, count(*) FILTER (event_type <> 'error') AS successful, (SELECT string_agg(v, ',' ORDER BY event_id) FROM (SELECT event_id, value::VARCHAR AS v FROM events WHERE value > 90 ORDER BY event_id LIMIT 5)) AS improvements, (SELECT string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FROM (SELECT event_id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 3)) AS errors FROM events""")
def improvement_report(spark, d):
    """Totals with the first five improvements and three errors (the report's numbers)."""
    rows = read(spark, d, "events").select(F.col("event_id").alias("place"), (~failed()).alias("success"), F.when(F.col("value") > 90, F.col("value").cast("string")).alias("improvement"), F.when(failed(), F.col("event_id").cast("string")).alias("error"))
    return R.improvement_report(rows).select("extractions", "successful", F.array_join("improvements", ",").alias("improvements"), F.array_join("errors", ",").alias("errors"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'success' WHEN lang = 'de' THEN 'success' ELSE 'error' END AS status, CASE lang WHEN 'en' THEN upper(source) WHEN 'de' THEN length(coalesce(text, ''))::VARCHAR END AS result FROM documents")
def dispatched_tools(spark, d):
    """A registered function by name for each row; a name that nobody registered is an error."""
    tools = G.Registry()
    tools.register("shout", lambda word: F.upper(word), {"word": "string"})
    tools.register("measure", lambda text: F.length(text), {"text": "string"})
    name = F.when(F.col("lang") == "en", "shout").when(F.col("lang") == "de", "measure").otherwise("none")
    return documents(spark, d).select("doc_id", tools.dispatch(name, {"word": F.col("source"), "text": F.col("text")}).alias("o")).select("doc_id", "o.status", "o.result")


@query("""SELECT user_id, array_to_string(list_filter([CASE WHEN NOT n BETWEEN 1 AND 10000 THEN 'max_pages out of range' END, CASE WHEN NOT m BETWEEN 0 AND 60 THEN 'delay out of range' END, CASE WHEN NOT e BETWEEN 0 AND 10 THEN 'retries out of range' END], lambda x: x IS NOT NULL), ';') AS errors FROM (SELECT user_id, count(*) * 20 AS n, avg(value) * 2 AS m, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1)""")
def job_validation(spark, d):
    """Jobs whose settings are out of range."""
    rows = read(spark, d, "events").groupBy("user_id").agg((F.count("*") * 20).alias("n"), (F.avg("value") * 2).alias("m"), F.count_if(failed()).alias("e"))
    return rows.select("user_id", F.array_join(V.errors(V.ranged("max_pages", F.col("n")), V.ranged("delay", F.col("m")), V.ranged("retries", F.col("e"))), ";").alias("errors"))
