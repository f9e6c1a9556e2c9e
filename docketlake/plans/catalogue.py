"""Queries by name over the given tables, each with its SQL where SQL can express it.

Events stand for learning sessions (user: source, event type: method, error: failure, value: items), orders and line
items for jobs and their steps, parties and places for sources and jurisdictions. Looks back count from the last
event. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketlake import dictionaries as D
from docketlake.functions import model as N
from docketlake.functions import scoring as S
from docketlake.functions import text as X
from docketlake.functions import urls as U
from docketlake.functions import validate as V
from docketlake.operators import changes as C
from docketlake.operators import documents as P
from docketlake.operators import learning as L
from docketlake.operators import monitoring as M
from docketlake.operators import sinks as W
from docketlake.operators import workflow as K
from docketlake.sources import html as H
from docketlake.sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# pieces of SQL
def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_keywords(words, c="lower(text)") -> str:
    return f"list_sum(list_transform({sql_list(words)}, lambda w: (length({c}) - length(replace({c}, w, ''))) // length(w)))::BIGINT"


def sql_present(words, c="lower(text)") -> str:
    return f"len(list_filter({sql_list(words)}, lambda w: contains({c}, w)))::BIGINT"


#: Letters beyond ASCII as a letter that no pattern names, since the SQL engine's word boundaries know ASCII alone.
SQL_ASCII = r"regexp_replace(coalesce(text, ''), '[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]', '_', 'g')"


def sql_regex(patterns, c=SQL_ASCII, flags="") -> str:
    return " + ".join(f"len(regexp_extract_all({c}, '{flags}{p}'))" for p in patterns)


SQL_WORDS = r"(CASE WHEN regexp_replace(text, '^\s+|\s+$', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) END)"
PROBE = ["the", "er", "ing", "de", "ción"]
def failed():
    return F.col("event_type") == "error"


def documents(spark, d):
    return read(spark, d, "documents").withColumn("text", X.text("text"))


def sessions(spark, d):
    return read(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("source_id"), F.col("event_type").alias("method"), (~failed()).alias("success"), F.col("value").alias("items"), F.col("props"))


def last_time(events, column="ts"):
    """The last time as a value of the query itself: no job runs while the plan is made."""
    return events.agg(F.max(column)).scalar()


CONTENT_ERROR = """CASE WHEN trim(text) = '' THEN 'empty' WHEN length(trim(text)) < 10 THEN 'too short' WHEN length(trim(text)) > 10000000 THEN 'too long'
    WHEN length(regexp_replace(trim(text), '[^\\p{L}]', '', 'g')) < 0.1 * length(trim(text)) THEN 'too few letters' END"""
DOC_SCORE = f"""(CASE WHEN {SQL_WORDS} > 1000 THEN 0.3 WHEN {SQL_WORDS} > 500 THEN 0.2 WHEN {SQL_WORDS} > 100 THEN 0.1 ELSE 0.0 END
    + 0.25 * least(len(string_split(text, chr(10))) / 10.0, 1.0) + 0.25 * least(({sql_keywords(D.LEGAL_KEYWORDS)}) / 10.0, 1.0))"""


def scored(docs):
    """``docs`` with the score of their texts; what it counts is a projection of its own, made once."""
    t = F.col("text")
    held = docs.withColumns({"_words": X.word_count(t), "_lines": F.size(F.split(t, "\n")), "_legal": X.keyword_total(t, D.LEGAL_KEYWORDS)})
    score = S.content_quality(F.col("_words"), F.least(F.col("_lines") / 10.0, F.lit(1.0)), F.col("_legal"), F.lit(0.0))
    return held.withColumn("score", score).drop("_words", "_lines", "_legal")


@query(f"""SELECT source, lang, count(*) AS n_docs, count(*) FILTER (({CONTENT_ERROR}) IS NULL) AS n_valid, round(avg({DOC_SCORE}), 6) AS mean_score
    FROM (SELECT source, lang, coalesce(text, '') AS text FROM documents) GROUP BY source, lang""")
def doc_quality_by_source_lang(spark, d):
    """Flagship: per source and language the documents, the valid ones and their mean quality score."""
    rows = scored(documents(spark, d).withColumn("ok", V.content(F.col("text")).isNull()))
    return rows.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.count_if("ok").alias("n_valid"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(f"""SELECT doc_id, array_to_string(list_filter([{CONTENT_ERROR}, CASE WHEN NOT coalesce(regexp_matches(lower(trim(lang)), '^[a-z]{{2,3}}$'), false) THEN 'invalid language' END,
    CASE WHEN NOT coalesce(length(trim(source)) BETWEEN 3 AND 200, false) THEN 'keyword length' END], lambda x: x IS NOT NULL), ';') AS errors FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)""")
def doc_validation_errors(spark, d):
    docs = documents(spark, d)
    return docs.select("doc_id", F.array_join(V.errors(V.content(F.col("text")), V.language(F.col("lang")), V.keyword(F.col("source"))), ";").alias("errors"))


@query(f"""SELECT count(*) AS total, count(*) FILTER (e IS NULL) AS valid, count(*) FILTER (e IS NOT NULL) AS invalid, round(coalesce(100.0 * count(*) FILTER (e IS NULL) / nullif(count(*), 0), 0), 6) AS success_rate
    FROM (SELECT {CONTENT_ERROR} AS e FROM (SELECT coalesce(text, '') AS text FROM documents))""")
def doc_validation_report(spark, d):
    e = documents(spark, d).select(V.content(F.col("text")).alias("e"))
    ok = F.count_if(F.col("e").isNull())
    return e.agg(F.count("*").alias("total"), ok.alias("valid"), F.count_if(F.col("e").isNotNull()).alias("invalid"), F.round(S.percent(ok, F.count("*")), 6).alias("success_rate"))


@query(f"SELECT doc_id, {sql_keywords(D.LEGAL_KEYWORDS)} AS legal, {sql_keywords(D.PAGE_LEGAL_KEYWORDS)} AS page_legal FROM documents")
def keyword_substring_counts(spark, d):
    t = F.col("text")
    return documents(spark, d).select("doc_id", X.keyword_total(t, D.LEGAL_KEYWORDS).alias("legal"), X.keyword_total(t, D.PAGE_LEGAL_KEYWORDS).alias("page_legal"))


@query(f"SELECT doc_id, {sql_keywords(PROBE)} AS hits FROM documents")
def keyword_substring_counts_probe(spark, d):
    return documents(spark, d).select("doc_id", X.keyword_total(F.col("text"), PROBE).alias("hits"))


@query(f"""SELECT doc_id, {sql_present(D.STATUS_PHRASES)} AS status_phrases, {sql_present(D.GOVERNMENT_TERMS)} AS government_terms, {sql_present(D.FORMAL_TERMS)} >= 3 AS official_language,
    {sql_present(D.INDICATOR_KEYWORDS)} >= 3 AS has_legal_indicators, {sql_present(PROBE)} >= 3 AS probe FROM documents""")
def keyword_presence_flags(spark, d):
    t = F.col("text")
    return documents(spark, d).select("doc_id", X.presence_count(t, D.STATUS_PHRASES).alias("status_phrases"), X.presence_count(t, D.GOVERNMENT_TERMS).alias("government_terms"), (X.presence_count(t, D.FORMAL_TERMS) >= 3).alias("official_language"), (X.presence_count(t, D.INDICATOR_KEYWORDS) >= 3).alias("has_legal_indicators"), (X.presence_count(t, PROBE) >= 3).alias("probe"))


REGEX_MEASURES = {
    "dates": (D.DATE_PATTERNS, False), "ids": (D.ID_PATTERNS, True), "numbered": (D.NUMBERED_PATTERNS, True), "numbered_text": (D.NUMBERED_TEXT_PATTERNS, True), "citations": (D.CITATION_PATTERNS, True),
    "page_citations": (D.PAGE_CITATION_PATTERNS, False), "content_citations": (D.CONTENT_CITATION_PATTERNS, True), "text_citations": (D.TEXT_CITATION_PATTERNS, True),
}


@query(f"""SELECT doc_id, {", ".join(f"({sql_regex(ps, 'a', '(?i)' if i else '')})::BIGINT AS {k}" for k, (ps, i) in REGEX_MEASURES.items())}, ({sql_regex(D.VERSION_PATTERNS, 'lower(a)')})::BIGINT AS versions FROM (SELECT doc_id, {SQL_ASCII} AS a FROM documents)""")
def regex_totals(spark, d):
    t = F.col("text")
    return documents(spark, d).select("doc_id", *(X.regex_total(t, ps, i).alias(k) for k, (ps, i) in REGEX_MEASURES.items()), X.regex_total(F.lower(t), D.VERSION_PATTERNS).alias("versions"))


@query(f"""SELECT doc_id, CASE WHEN s >= .9 THEN 'excellent' WHEN s >= .7 THEN 'good' WHEN s >= .5 THEN 'fair' WHEN s >= .3 THEN 'poor' ELSE 'unacceptable' END AS quality,
    CASE WHEN s >= .9 THEN 'very_high' WHEN s >= .7 THEN 'high' WHEN s >= .5 THEN 'medium' WHEN s >= .3 THEN 'low' ELSE 'very_low' END AS confidence FROM (SELECT doc_id, round({DOC_SCORE}, 6) AS s FROM documents)""")
def quality_tiers(spark, d):
    s = F.round("score", 6)
    return scored(documents(spark, d)).select("doc_id", S.quality_tier(s).alias("quality"), S.confidence_level(s).alias("confidence"))


@query(r"""SELECT doc_id, round(least(1.0, (CASE WHEN length(text) > 1000 THEN .3 WHEN length(text) > 500 THEN .2 ELSE 0 END) + (CASE WHEN len(string_split(text, chr(10))) > 1 THEN .25 ELSE 0 END)
    + (CASE WHEN source IS NOT NULL THEN .15 ELSE 0 END) + (CASE WHEN lang <> 'en' THEN .1 ELSE 0 END)), 6) AS completeness FROM documents""")
def completeness_score(spark, d):
    n = F.size(F.split("text", "\n")) - 1
    return documents(spark, d).select("doc_id", F.round(S.completeness(F.length("text"), n, F.lit(0), F.col("source").isNotNull(), F.col("lang") != "en"), 6).alias("completeness"))


@query(rf"""WITH t AS (SELECT doc_id, {SQL_ASCII} AS a FROM documents), r AS (SELECT doc_id, a, unnest(regexp_extract_all(a, '(?i){D.INTERNAL_REFERENCE}', 1)) AS ref FROM t),
    b AS (SELECT doc_id, count(*) AS n, count(*) FILTER (NOT regexp_matches(a, '(?i)Section\s+' || regexp_escape(ref))) AS broken FROM r GROUP BY doc_id)
    SELECT doc_id, ({sql_regex(D.CITATION_PATTERNS, 'a', '(?i)')})::BIGINT AS citations, coalesce(n, 0)::INT AS internal_references, coalesce(broken, 0)::INT AS broken, round(greatest(0.0, 1.0 - 0.1 * coalesce(broken, 0)), 6) AS citation_score FROM t LEFT JOIN b USING (doc_id)""")
def citation_score(spark, d):
    """Citations, references inside the text, those to sections that it doesn't have, and the score."""
    t = F.col("text")
    refs = F.regexp_extract_all(t, F.lit(X.engine_form(D.INTERNAL_REFERENCE, True)), F.lit(1))
    rows = documents(spark, d).select("doc_id", X.regex_total(t, D.CITATION_PATTERNS, True).alias("citations"), refs.alias("refs"), X.broken_references(t, refs).alias("broken"))
    return rows.select("doc_id", "citations", F.size("refs").alias("internal_references"), F.size("broken").alias("broken"), F.round(S.issues_score(F.size("broken")), 6).alias("citation_score"))


@query(r"""WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
    m AS (SELECT *, CASE WHEN contains(lower(line), 'the ') OR contains(lower(line), 'de ') THEN 1 ELSE 0 END AS opens FROM l),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM m)
    SELECT doc_id, section::BIGINT AS section, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM s WHERE section > 0 GROUP BY doc_id, section""")
def sections_from_lines(spark, d):
    """Gaps and islands over lines: a line with a marker opens a section."""
    return documents(spark, d).select("doc_id", F.explode(X.section_sizes(F.col("text"), ["the ", "de "])).alias("s")).select("doc_id", "s.section", "s.n_lines", "s.n_chars")


@query(r"""WITH s AS (SELECT doc_id, unnest(x) AS sentence, generate_subscripts(x, 1) AS i, len(x) AS n FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?]') AS x FROM documents)),
    k AS (SELECT * FROM s WHERE trim(sentence) <> '' AND (regexp_matches(sentence, '[0-9]{4}') OR i <= 2 OR i > n - 2)),
    u AS (SELECT doc_id, trim(sentence) AS sentence, min(i) AS i FROM k GROUP BY ALL)
    SELECT doc_id, sentence, n FROM (SELECT doc_id, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM u) WHERE n <= 20""")
def date_sentences(spark, d):
    """Sentences with a year, and the first and last two: one of each, the first 20 by place (the operator's limit)."""
    return documents(spark, d).select("doc_id", F.posexplode(X.date_sentences(F.col("text"))).alias("i", "sentence")).select("doc_id", "sentence", (F.col("i") + 1).alias("n"))


@query(r"""WITH t AS (SELECT conv_id, turn, list_distinct(string_split(text, ' ')[1:50]) AS w FROM conversations), p AS (SELECT *, lead(w) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM t)
    SELECT conv_id, turn, round(len(list_intersect(w, nx))::DOUBLE / least(len(w), len(nx)), 6) AS overlap FROM p WHERE nx IS NOT NULL""")
def adjacent_coherence(spark, d):
    """Overlap of the first 50 words of each turn and the next."""
    t = read(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(F.slice(F.split("text", " "), 1, 50)).alias("w"))
    p = t.withColumn("nx", F.lead("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("nx IS NOT NULL")
    return p.select("conv_id", "turn", F.round(F.size(F.array_intersect("w", "nx")) / F.least(F.size("w"), F.size("nx")), 6).alias("overlap"))


@query("SELECT sha256(coalesce(text, '')) AS content_hash, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1")
def dedup_exact(spark, d):
    return documents(spark, d).groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query("""WITH h AS (SELECT source, doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents), p AS (SELECT *, lag(content_hash) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM h)
    SELECT source, doc_id, content_hash, CASE WHEN prev IS NULL THEN 'baseline' WHEN prev = content_hash THEN 'unchanged' ELSE 'modified' END AS change FROM p""")
def change_status_by_version(spark, d):
    return C.change_status(read(spark, d, "documents"), "source", "doc_id", "text").select("source", "doc_id", "content_hash", "change")


@query()
def change_diffs(spark, d):
    return C.changes(read(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "content_hash", "diff")


@query(r"""SELECT page_id, CASE WHEN NOT coalesce(regexp_matches(trim(url), '^https?://[^/?#\s]+'), false) THEN 'invalid url' END AS error,
    lower(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:\s]+)', 1), '')) AS host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\s]+([^?#]*)', 1) AS path,
    nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query FROM pages""")
def url_parts(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", V.url(u).alias("error"), U.host(u).alias("host"), U.path(u).alias("path"), U.query_of(u).alias("query"))


@query("""SELECT host, count(*) AS n FROM (SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host FROM pages) GROUP BY host""")
def pages_by_host(spark, d):
    return read(spark, d, "pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(f"""SELECT page_id, {sql_present(D.API_TERMS, 'lower(html)')} AS api_terms, round(least(1.0, 0.2 * {sql_present(D.API_TERMS, 'lower(html)')}), 6) AS api_readiness,
    {sql_present(D.SPA_TERMS, 'lower(html)')} > 0 AS spa, {sql_present(D.SPA_FRAMEWORKS, 'lower(html)')} > 0 AS framework,
    round((CASE WHEN len(regexp_extract_all(lower(html), '<script')) > 5 THEN .3 ELSE 0 END) + (CASE WHEN {sql_present(D.SPA_FRAMEWORKS, 'lower(html)')} > 0 THEN .4 ELSE 0 END) + (CASE WHEN contains(lower(html), 'loading...') OR contains(lower(html), 'spinner') THEN .3 ELSE 0 END), 6) AS js_need FROM pages""")
def page_technology(spark, d):
    t = F.col("html")
    rows = read(spark, d, "pages").select("page_id", X.presence_count(t, D.API_TERMS).alias("api_terms"), (X.presence_count(t, D.SPA_TERMS) > 0).alias("spa"), (X.presence_count(t, D.SPA_FRAMEWORKS) > 0).alias("framework"), P.technology(t).alias("t"))
    return rows.select("page_id", "api_terms", "t.api_readiness", "spa", "framework", F.col("t.needs_scripts").alias("js_need"))


@query(r"""SELECT page_id, lower(regexp_extract(html, '<html lang="([a-zA-Z]+)', 1)) AS lang, len(regexp_extract_all(html, '<a '))::BIGINT AS n_anchors, len(regexp_extract_all(html, '<li>'))::BIGINT AS n_items,
    len(regexp_extract_all(html, '<h1>'))::BIGINT AS n_h1 FROM pages""")
def html_counts(spark, d):
    """From the parsed record; the SQL counts the same tags in the text."""
    p = F.col("page")
    return H.parsed(read(spark, d, "pages"), fields=["lang", "meta", "tags"]).select("page_id", H.language(p).alias("lang"), H.tag(p, "a").cast("long").alias("n_anchors"), H.tag(p, "li").cast("long").alias("n_items"), H.tag(p, "h1").cast("long").alias("n_h1"))


@query()
def html_records(spark, d):
    p = F.col("page")
    t = p["body_text"]
    return H.parsed(read(spark, d, "pages"), fields=["title", "headings", "links", "body_text", "depth", "meta", "tables", "paragraphs"]).select("page_id", H.title(p).alias("title"), X.word_count(t).alias("n_words"), F.length(t).alias("n_chars"), H.headings_in_order(p).alias("headings_ok"), F.size(p["links"]).alias("n_links"), F.size(H.document_links(p, 1 << 30)).alias("n_document_links"), p["depth"].alias("depth"), F.size(p["meta"]).alias("n_meta"))


@query()
def html_links(spark, d):
    link = F.col("l")
    return H.parsed(read(spark, d, "pages"), fields=["links"]).select("page_id", "url", F.explode("page.links").alias("l")).select("page_id", U.resolve(F.col("url"), link["href"]).alias("href"), link["text"].alias("text"), U.link_type(link["href"]).alias("type"))


SESSIONS = "(SELECT event_id, ts, user_id AS source_id, event_type AS method, event_type <> 'error' AS success, value AS items FROM events)"
REPORT = """count(*) AS total, count(*) FILTER (success) AS successful, round(100.0 * count(*) FILTER (success) / count(*), 6) AS success_rate,
    round(coalesce(sum(items) FILTER (success), 0), 6) AS total_items, round(coalesce(avg(items) FILTER (success), 0), 6) AS avg_items"""


@query(f"SELECT source_id, {REPORT} FROM {SESSIONS} WHERE ts > (SELECT max(ts) - INTERVAL 7 DAY FROM events) GROUP BY source_id")
def session_insights(spark, d):
    s = sessions(spark, d)
    return M.session_report(M.since(s, "ts", last_time(s), 7, strict=True), "source_id")


@query(f"SELECT method, {REPORT} FROM {SESSIONS} GROUP BY method")
def session_insights_by_method(spark, d):
    return M.session_report(sessions(spark, d), "method")


@query(f"SELECT source_id, event_id, recency FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, event_id DESC) AS recency FROM {SESSIONS} WHERE NOT success) WHERE recency <= 5")
def session_last_errors(spark, d):
    return M.last_n(sessions(spark, d).where("NOT success"), "source_id", ["ts", "event_id"], 5).select("source_id", "event_id", "recency")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, event_id DESC) AS n FROM {SESSIONS} WHERE success)
    SELECT source_id, method, count(*) AS uses, round(sum(items), 6) AS items FROM r WHERE n <= 10 GROUP BY source_id, method""")
def last10_pattern_uses(spark, d):
    return M.last_n(sessions(spark, d).where("success"), "source_id", ["ts", "event_id"], 10).groupBy("source_id", "method").agg(F.count("*").alias("uses"), F.round(F.sum("items"), 6).alias("items"))


@query(f"""SELECT event_id, count(*) OVER w AS n, round(count(*) FILTER (success) OVER w / count(*) OVER w, 6) AS running_confidence, round(avg(items) OVER w, 9) AS running_items FROM {SESSIONS}
    WINDOW w AS (PARTITION BY source_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_means(spark, d):
    return L.running_confidence(sessions(spark, d), "source_id", ["ts", "event_id"]).select("event_id", "n", "running_confidence", "running_items")


@query(f"""SELECT source_id, count(*) FILTER (success) AS success_count, count(*) FILTER (NOT success) AS failure_count, round(count(*) FILTER (success) / count(*), 6) AS confidence,
    round(avg(items) FILTER (success AND items > 0), 6) AS avg_items FROM {SESSIONS} GROUP BY source_id""")
def pattern_totals(spark, d):
    return L.use_totals(sessions(spark, d), "source_id")


@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts, event_id) AS n, items / 20 AS seconds FROM {SESSIONS}),
    r AS (SELECT source_id, 0::BIGINT AS n, 0::DOUBLE AS s, 0::DOUBLE AS f, 0.5::DOUBLE AS c FROM (SELECT DISTINCT source_id FROM e) UNION ALL
    SELECT r.source_id, r.n + 1, r.s + e.success::INT, r.f + (NOT e.success)::INT, CASE WHEN e.success THEN least(1.0, (r.s + 1) / (r.s + r.f + 1) + (CASE WHEN e.items >= 10 THEN least(0.05, 0.003 * e.items) ELSE 0 END)
      + (CASE WHEN e.seconds > 0 AND e.seconds < 10 THEN (10 - e.seconds) / 100 ELSE 0 END) + 0.01)
      ELSE greatest(0.0, r.s / (r.s + r.f + 1) - (CASE WHEN r.s + r.f + 1 >= 5 AND (r.f + 1) / (r.s + r.f + 1) > 0.5 THEN least(0.1, 0.1 * (r.f + 1) / (r.s + r.f + 1)) ELSE 0 END)) END
    FROM r JOIN e ON e.source_id = r.source_id AND e.n = r.n + 1)
    SELECT source_id, s::BIGINT AS success_count, f::BIGINT AS failure_count, round(c, 6) AS confidence FROM r QUALIFY n = max(n) OVER (PARTITION BY source_id)""")
def reinforced_confidence(spark, d):
    return L.reinforced(sessions(spark, d).withColumn("seconds", F.col("items") / 20), "source_id", ["ts", "event_id"])


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events), v AS (SELECT event_type, list_sort(list(value)) AS v, avg(value) AS mean, median(value) AS median FROM r WHERE k <= 100 GROUP BY 1)
    SELECT event_type, len(v)::INT AS n, round(mean, 6) AS mean, round(median, 6) AS median, round(v[floor((len(v) + 1) * 0.95)::INT] + ((len(v) + 1) * 0.95 - floor((len(v) + 1) * 0.95)) * (v[floor((len(v) + 1) * 0.95)::INT + 1] - v[floor((len(v) + 1) * 0.95)::INT]), 6) AS p95 FROM v""")
def response_stats_last100(spark, d):
    return K.last_hundred(read(spark, d, "events"), "event_type", ["ts", "event_id"])


@query("""WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0::DOUBLE AS s, 0::DOUBLE AS p FROM events UNION ALL SELECT r.user_id, r.n + 1, r.s * 0.9 + e.value * (1 - 0.9::DOUBLE), greatest(r.p, e.value) FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT user_id, round(s, 6) AS smoothed, p AS peak FROM r QUALIFY n = max(n) OVER (PARTITION BY user_id)""")
def smoothed_values(spark, d):
    return K.smoothed(read(spark, d, "events"), "user_id", ["ts", "event_id"])


@query("""SELECT user_id AS agent_id, max(ts) AS last_heartbeat, epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) > 360 * 60000000::BIGINT AS offline FROM events GROUP BY user_id""")
def heartbeat_offline(spark, d):
    e = read(spark, d, "events")
    return K.offline(e.select(F.col("user_id").alias("agent_id"), "ts"), last_time(e), minutes=360)


@query("""SELECT event_id FROM events WHERE epoch_us((SELECT max(ts) FROM events)) <= epoch_us(ts) + (CASE event_type WHEN 'view' THEN 86400 WHEN 'click' THEN 604800 ELSE 2592000 END) * 1000000::BIGINT""")
def ttl_live(spark, d):
    e = read(spark, d, "events")
    return K.live(e, last_time(e), F.when(F.col("event_type") == "view", 86400).when(F.col("event_type") == "click", 604800).otherwise(2592000).cast("long")).select("event_id")


@query("""WITH w AS (SELECT unnest(['view', 'signup', 'purchase', 'error', 'click', 'critical']) AS event_type), c AS (SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM events) GROUP BY 1)
    SELECT coalesce(w.event_type, c.event_type) AS event_type, coalesce(n, 0) AS n FROM w FULL JOIN c ON w.event_type = c.event_type""")
def change_summary_zero_fill(spark, d):
    e = read(spark, d, "events")
    return M.zero_filled(M.since(e, "ts", last_time(e), 7), "event_type", ["view", "signup", "purchase", "error", "click", "critical"])


@query("""SELECT event_type, count(*) FILTER (epoch_us(ts) > (SELECT epoch_us(max(ts)) FROM events) - 10 * 86400000000::BIGINT) AS kept_10, count(*) FILTER (epoch_us(ts) > (SELECT epoch_us(max(ts)) FROM events) - 20 * 86400000000::BIGINT) AS kept_20 FROM events GROUP BY 1""")
def retention_days(spark, d):
    e = read(spark, d, "events")
    edge = X.micros(F.lit(last_time(e)))
    kept = {f"kept_{n}": F.count_if(X.micros("ts") > edge - n * 86_400_000_000) for n in (10, 20)}
    return e.groupBy("event_type").agg(*(c.alias(k) for k, c in kept.items()))


@query("SELECT k, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events) GROUP BY k")
def props_json_fields(spark, d):
    return read(spark, d, "events").select(F.from_json("props", "k long")["k"].alias("k"), "value").groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


PARTIES = """(SELECT s_suppkey AS source_id, s_name AS name, r_name AS jurisdiction, n_name AS agency, CASE WHEN s_acctbal > 5000 THEN 'large' ELSE 'small' END AS source_type, s_acctbal > 0 AS is_active, s_acctbal / 10000 AS confidence
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def parties(spark, d):
    places = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = read(spark, d, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"), F.col("r_name").alias("jurisdiction"), F.col("n_name").alias("agency"), F.when(F.col("s_acctbal") > 5000, "large").otherwise("small").alias("source_type"), (F.col("s_acctbal") > 0).alias("is_active"), (F.col("s_acctbal") / 10000).alias("confidence"), F.lit(None).cast("timestamp").alias("last_checked"))


@query(f"""SELECT grouping(jurisdiction, agency, source_type)::BIGINT AS level, jurisdiction, agency, source_type, count(*) AS n, count(*) FILTER (is_active) AS n_active, round(avg(confidence), 6) AS avg_confidence
    FROM {PARTIES} GROUP BY GROUPING SETS ((jurisdiction), (agency), (source_type), ())""")
def source_stats_grouping_sets(spark, d):
    return M.discovery_statistics(parties(spark, d))


@query(f"SELECT source_id, name, jurisdiction, printf('%.2f', confidence) AS confidence, 'Never' AS last_checked FROM {PARTIES} WHERE jurisdiction = 'ASIA' AND is_active")
def source_filter_listing(spark, d):
    return M.source_listing(parties(spark, d), jurisdiction="ASIA", active=True)


@query(f"SELECT source_id FROM {PARTIES} WHERE is_active AND jurisdiction IN ('ASIA', 'EUROPE')")
def selected_sources(spark, d):
    return M.selected_sources(parties(spark, d), jurisdictions=["ASIA", "EUROPE"]).select("source_id")


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) >= 2")
def common_values_across_sources(spark, d):
    c = read(spark, d, "customer")
    keep = L.common_values(c, "c_mktsegment", 2, distinct="c_nationkey").select("c_mktsegment")
    return c.join(keep, "c_mktsegment", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT p_brand, p_partkey, place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part WHERE p_retailprice >= 1000) WHERE place <= 3")
def best_per_group(spark, d):
    return L.best(read(spark, d, "part"), "p_brand", "p_retailprice", 1000, "p_partkey", 3).select("p_brand", "p_partkey", "place")


@query("""SELECT l_orderkey AS workflow_id, count(*) AS total, count(*) FILTER (l_linestatus = 'F') AS completed, round(count(*) FILTER (l_linestatus = 'F') / count(*), 6) AS progress,
    CASE WHEN bool_or(l_returnflag = 'R' AND l_linestatus <> 'F') THEN 'failed' WHEN bool_and(l_linestatus = 'F') THEN 'completed' ELSE 'running' END AS final_status FROM lineitem GROUP BY 1""")
def workflow_final_status(spark, d):
    s = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("workflow_id"), F.when(F.col("l_linestatus") == "F", "completed").when(F.col("l_returnflag") == "R", "failed").otherwise("pending").alias("status"))
    return K.progress(s)


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS w, l_linenumber AS i, CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'pending' END AS st FROM lineitem)
    SELECT a.w AS workflow_id, a.i AS step_id FROM s a WHERE a.st = 'pending' AND (a.i = 1 OR EXISTS (SELECT 1 FROM s b WHERE b.w = a.w AND b.i = a.i - 1 AND b.st = 'completed'))""")
def dag_ready_steps(spark, d):
    """Step n of an order depends on step n - 1."""
    s = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("workflow_id"), F.col("l_linenumber").alias("step_id"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("pending").alias("status")).distinct()
    deps = F.when(F.col("step_id") > 1, F.array(F.col("step_id") - 1)).otherwise(F.array().cast("array<int>"))
    return K.ready(s.withColumn("dependencies", deps)).select("workflow_id", "step_id")


@query("""SELECT o_orderkey AS step_id, n AS retry_count, CASE WHEN n < 3 THEN 'pending' ELSE 'failed' END AS status FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey""")
def retry_outcome(spark, d):
    steps = read(spark, d, "orders").select(F.col("o_orderkey").alias("step_id"), F.lit("running").alias("status"), F.lit(0).cast("long").alias("retry_count"), F.lit(3).alias("max_retries"))
    fails = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("step_id"))
    return K.retries(steps, fails).where("retry_count > 0").select("step_id", "retry_count", "status")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate > (SELECT max(o_orderdate) - INTERVAL 365 DAY FROM orders)")
def active_orders(spark, d):
    o = read(spark, d, "orders")
    return M.since(o.where(F.col("o_orderstatus").isin("O", "P")), "o_orderdate", last_time(o, "o_orderdate"), 365, strict=True).select("o_orderkey", "o_orderstatus")


@query("""SELECT o_orderkey, l_partkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 7 DAY FROM orders)""")
def recent_jobs(spark, d):
    """Membership of array elements: exploded and joined on equality."""
    o = read(spark, d, "orders")
    held = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    recent = M.since(o, "o_orderdate", last_time(o, "o_orderdate"), 7).join(held, F.col("o_orderkey") == F.col("l_orderkey"))
    return recent.select("o_orderkey", F.explode(F.array_distinct("parts")).alias("l_partkey"))


@query("SELECT o_orderkey, count(l_orderkey) FILTER (l_returnflag = 'R') > 0 AS has_documents, count(l_orderkey) FILTER (l_returnflag = 'R') AS n_documents FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def job_summary(spark, d):
    """The length of an empty array is null, which stands apart here as has_documents."""
    docs = read(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_documents"))
    joined = read(spark, d, "orders").select("o_orderkey").join(docs, "o_orderkey", "left")
    return joined.select("o_orderkey", F.col("n_documents").isNotNull().alias("has_documents"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


@query("""SELECT l_orderkey AS job_id, l_shipmode_kind AS kind, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_kind FROM lineitem) GROUP BY 1, 2""")
def extraction_summary(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.concat("l_returnflag", "l_linestatus").alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"))


QUEUES = {"user": "orchestrator", "assistant": "validation"}


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'orchestrator' WHEN 'assistant' THEN 'validation' END AS queue FROM conversations")
def queue_route(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", K.route(F.col("role"), F.lit(None).cast("string"), [], QUEUES).alias("queue"))


@query("""WITH m AS (SELECT *, CASE event_type WHEN 'view' THEN 'orchestrator' WHEN 'click' THEN 'validation' END AS queue FROM events), p AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY ts, event_id) AS n FROM m)
    SELECT event_id, queue, CASE WHEN queue IS NULL THEN 'no_route' WHEN n > 1000 THEN 'queue_full' ELSE 'queued' END AS outcome FROM p""")
def dead_letters(spark, d):
    e = read(spark, d, "events").withColumn("queue", K.route(F.col("event_type"), F.lit(None).cast("string"), [], {"view": "orchestrator", "click": "validation"}))
    return K.dispatch(e.withColumnRenamed("event_id", "message_id"), 1000).select(F.col("message_id").alias("event_id"), "queue", "outcome")


@query("""WITH c AS (SELECT unnest(['view', 'click', 'idle']) AS queue, unnest([2000, 100000, 10]) AS max_size), n AS (SELECT event_type AS queue, count(*) AS n FROM events GROUP BY 1)
    SELECT c.queue, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / max_size, 6) AS utilisation, coalesce(n, 0) / max_size >= 0.8 AS alert FROM c LEFT JOIN n ON c.queue = n.queue""")
def queue_utilisation(spark, d):
    return K.utilisation(read(spark, d, "events").withColumnRenamed("event_type", "queue"), {"view": 2000, "click": 100000, "idle": 10})


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS whole, count(*) AS n FROM conversations GROUP BY conv_id")
def ordered_concat(spark, d):
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"), F.count("*").alias("n"))
    return c.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("whole"), "n")


@query("SELECT source, count(*) AS n_docs, count(l.doc_id) AS n_labelled, round(avg(quality), 6) AS mean_quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source")
def label_coverage(spark, d):
    j = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels").withColumn("_l", F.lit(1)), "doc_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("n_docs"), F.count("_l").alias("n_labelled"), F.round(F.avg("quality"), 6).alias("mean_quality"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark, d):
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def classification_statistics(spark, d):
    return read(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("""SELECT b.item_id, d.doc_id, length(b.text) AS n_benchmark, length(d.text) AS n_doc FROM (SELECT *, row_number() OVER (ORDER BY item_id) AS n FROM benchmark) b JOIN (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM documents) d ON b.n = d.n WHERE b.n <= 3""")
def positional_pairs(spark, d):
    """The first three items beside the first three documents (three is the operator's number)."""
    def first(df, key):
        return df.orderBy(key).limit(3).withColumn("n", F.row_number().over(Window.orderBy(key)))

    b, x = first(read(spark, d, "benchmark"), "item_id"), first(read(spark, d, "documents"), "doc_id")
    return b.alias("b").join(x.alias("d"), "n").select("item_id", "doc_id", F.length("b.text").alias("n_benchmark"), F.length("d.text").alias("n_doc"))


@query(f"""WITH s AS (SELECT user_id AS source_id, count(*) AS sessions, count(*) FILTER (event_type <> 'error') / count(*) AS success_rate, count(*) FILTER (value < 1) AS weak_patterns FROM events GROUP BY 1)
    SELECT source_id, 'high' AS priority, 'data_collection' AS action FROM s WHERE sessions < 5 UNION ALL SELECT source_id, 'medium', 'optimisation' FROM s WHERE weak_patterns > 0 UNION ALL SELECT source_id, 'medium', 'opportunity' FROM s WHERE sessions >= 5 AND success_rate < 0.7""")
def pattern_recommendations(spark, d):
    s = read(spark, d, "events").groupBy(F.col("user_id").alias("source_id")).agg(F.count("*").alias("sessions"), (F.count_if(~failed()) / F.count("*")).alias("success_rate"), F.count_if(F.col("value") < 1).alias("weak_patterns"))
    return L.recommendations(s)


PROBE_TYPES = {"a": ["the", "ing"], "b": ["de", "la"], "c": ["er"]}
SQL_FRAMEWORKS = ", ".join(f"CASE WHEN {sql_present([w.lower() for w in ws], 'lower(html)')} > 0 THEN '{name}' END" for name, ws in D.FRAMEWORKS.items())


@query(f"""SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'other' WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS label
    FROM (SELECT doc_id, {sql_keywords(PROBE_TYPES['a'])} AS a, {sql_keywords(PROBE_TYPES['b'])} AS b, {sql_keywords(PROBE_TYPES['c'])} AS c FROM documents)""")
def document_labels(spark, d):
    return documents(spark, d).select("doc_id", X.best_label(F.col("text"), PROBE_TYPES, "other").alias("label"))


@query(f"""SELECT page_id, array_to_string(list_filter([{SQL_FRAMEWORKS}], lambda x: x IS NOT NULL), ',') AS frameworks FROM pages""")
def page_frameworks(spark, d):
    return read(spark, d, "pages").select("page_id", F.array_join(X.labels_present(F.col("html"), D.FRAMEWORKS), ",").alias("frameworks"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(l, '\.pdf') THEN 'pdf' WHEN regexp_matches(l, '\.docx?') THEN 'word' WHEN regexp_matches(l, 'regulation|act|bill|law') THEN 'legal' WHEN regexp_matches(l, 'archive|historical|past') THEN 'archive' ELSE 'general' END AS type,
    round(0.5 + CASE WHEN regexp_matches(l, '\.gov|\.europa\.eu|\.gc\.ca') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(l, 'parliament|legislation|regulation|law') THEN 0.2 ELSE 0 END, 6) AS complexity FROM (SELECT page_id, lower(url) AS l FROM pages)""")
def url_types(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", U.link_type(u).alias("type"), F.round(U.complexity(u), 6).alias("complexity"))


@query(f"""SELECT doc_id, {SQL_WORDS}::BIGINT AS n_words, length(text) AS n_chars, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p) <> ''))::BIGINT AS n_paragraphs FROM documents""")
def text_statistics(spark, d):
    t = F.col("text")
    return documents(spark, d).select("doc_id", X.word_count(t).alias("n_words"), F.length(t).alias("n_chars"), X.paragraph_count(t).alias("n_paragraphs"))


@query("SELECT o_orderkey AS job_id FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n <= 7")
def admitted_jobs(spark, d):
    """Seven places are free (the operator's number)."""
    return K.admitted(read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at")), 7).select("job_id")


@query("SELECT min(doc_id) AS item_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE source = 'src0') GROUP BY text")
def unseen_documents(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "source", F.sha2(F.col("text").cast("binary"), 256).alias("url"))
    return M.unseen(docs, docs.where("source = 'src0'")).select("item_id")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def upserted_customers(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return L.upsert(c, c.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("new")), "c_custkey")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1")
def cascaded_lines(spark, d):
    """Line items that stay when finished orders go."""
    gone = read(spark, d, "orders").where("o_orderstatus = 'F'")
    return W.cascade(read(spark, d, "lineitem"), gone, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE walk(start, url, n) AS (SELECT c_custkey, c_custkey, 1 FROM customer UNION ALL SELECT start, url + 7, n + 1 FROM walk WHERE n < 10 AND url + 7 <= (SELECT max(c_custkey) FROM customer))
    SELECT start, url, n FROM walk""")
def followed_pages(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("url"))
    links = c.select("url", F.when(F.col("url") + 7 <= last_time(c, "url"), F.col("url") + 7).alias("next_url"))
    return P.follow_pages(links, c, 10)


@query("SELECT conv_id, count(*)::INT AS n_pages, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, coalesce(text, '')) AS text FROM conversations GROUP BY conv_id")
def merged_turns(spark, d):
    return P.merged_pages(read(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "n_pages", "text")


@query()
def document_identity(spark, d):
    i = P.identity(F.lit(""), F.col("text"), F.col("source"))
    return documents(spark, d).select("doc_id", i.alias("i")).select("doc_id", "i.*")


@query()
def rule_classification(spark, d):
    c = N.classification(N.rule_scorer(F.col("text")))
    return documents(spark, d).select("doc_id", c.alias("c")).groupBy("c.category", "c.impact").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n, bool_and(lang IN ('en', 'es', 'fr', 'de')) AS known FROM documents GROUP BY lang")
def languages(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.every(V.known_language(F.col("lang"))).alias("known"))


@query("""SELECT user_id, CASE WHEN q >= 0.8 AND e = 0 THEN 'complete' WHEN q < 0.5 AND e < 3 THEN 'retry' WHEN e >= 3 THEN 'fail' ELSE 'handoff_validation' END AS action FROM (SELECT user_id, round(avg(value) / 50, 6) AS q, count(*) FILTER (event_type = 'error') // 20 AS e FROM events GROUP BY user_id)""")
def source_actions(spark, d):
    rows = read(spark, d, "events").groupBy("user_id").agg(F.round(F.avg("value") / 50, 6).alias("q"), F.floor(F.count_if(failed()) / 20).alias("e"))
    return rows.select("user_id", S.stage_action(F.col("q"), F.col("e"), F.lit("validation")).alias("action"))


# more queries register themselves
from docketlake.plans import monitored, operations, scores, searching, stored, streams, trees  # noqa: E402, F401
