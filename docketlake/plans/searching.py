"""Queries of the full-text search, with SQL that stems by the same table of rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docketlake.functions import stemming as E
from docketlake.operators import search as Q
from docketlake.plans.catalogue import query, sql_list
from docketlake.sources.tables import read, shared_path

ASKED = "the ereres' eroning"
TERMS = Q.terms_of(ASKED)


def sql_condition(c: str, rest: str) -> str:
    if c in (E.R1, E.R2):
        return f"CASE WHEN long THEN regexp_matches({rest}, '{E.region(c, True)}') ELSE regexp_matches({rest}, '{E.region(c, False)}') END"
    return f"{'NOT ' if c.startswith('!') else ''}regexp_matches({rest}, '{c.lstrip('!')}')"


def sql_step(rules: list[E.Rule]) -> str:
    """The CASE of one step for the word x."""
    out = []
    for suffix in dict.fromkeys(r[0] for r in rules):
        rest = f"left(x, length(x) - {len(suffix)})"
        cases = "".join(f" WHEN {' AND '.join(sql_condition(c, rest) for c in conditions) or 'true'} THEN {rest} || '{new}'" for s, new, conditions in rules if s == suffix)
        out.append(f"WHEN ends_with(x, '{suffix}') THEN CASE{cases} ELSE x END")
    return "CASE " + " ".join(out) + " ELSE x END"


def sql_stems() -> str:
    """CTEs from tokens (doc_id, w, i) to stems (w, stem), stop words left out."""
    parts = [f"s0 AS (SELECT w, regexp_matches(w, '{E.LONG}') AS long, regexp_replace(regexp_replace(w, '^y', 'Y'), '({E.V})y', '\\1Y', 'g') AS x FROM (SELECT DISTINCT w FROM tokens) WHERE NOT list_contains({sql_list(sorted(E.STOP_WORDS))}, w))"]
    for k, step in enumerate(E.STEPS):
        case = sql_step(step)
        parts.append(f"s{k + 1} AS (SELECT w, long, {case if k == 0 else f'CASE WHEN list_contains({sql_list(E.KEPT)}, x) AND kept THEN x ELSE {case} END'} AS x{', true AS kept' if k == 0 else ', kept AND list_contains(' + sql_list(E.KEPT) + ', x) AS kept'} FROM s{k})")
    own = " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in E.EXCEPTIONS.items())
    return ", ".join(parts) + f", stems AS (SELECT w, CASE WHEN length(w) < 3 THEN w ELSE CASE w {own} ELSE replace(x, 'Y', 'y') END END AS stem FROM s{len(E.STEPS)})"


SQL_PLACES = rf"""tokens AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS ws FROM documents)), {sql_stems()},
    places AS (SELECT doc_id, stem, pos FROM (SELECT DISTINCT doc_id, stem, least(i, 16383) AS pos FROM tokens JOIN stems USING (w) WHERE list_contains({sql_list(TERMS)}, stem)) QUALIFY row_number() OVER (PARTITION BY doc_id, stem ORDER BY pos) <= 256)"""
SQL_RANKS = f"""{SQL_PLACES}, pairs AS (SELECT a.doc_id, abs(a.pos - b.pos) AS d FROM places a JOIN places b USING (doc_id) WHERE a.stem < b.stem),
    ranks AS (SELECT doc_id, round(1 - exp(sum(ln(1 - 0.1::DOUBLE * sqrt(CASE WHEN d > 100 THEN 1e-30::DOUBLE ELSE 1 / (1.005::DOUBLE + 0.05::DOUBLE * exp(d / 1.5::DOUBLE - 2)) END)))), 9) AS rank FROM pairs WHERE d > 0 GROUP BY doc_id)"""


@query(f"WITH {SQL_RANKS} SELECT doc_id, rank FROM ranks")
def search_ranks(spark, d):
    """Every document with both stems, and its rank by their nearness."""
    return Q.matches(Q.index(read(spark, d, "documents"), "doc_id", "text"), ASKED)


@query(f"""WITH {SQL_PLACES}, tails AS (SELECT doc_id, pos, least({", ".join(f"max(CASE WHEN stem = '{t}' THEN pos END) OVER w" for t in TERMS)}) AS begin, {", ".join(f"max(CASE WHEN stem = '{t}' THEN pos END) OVER w AS l{k}" for k, t in enumerate(TERMS))} FROM places WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    ends AS (SELECT *, lag(begin) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM tails WHERE {" AND ".join(f"l{k} IS NOT NULL" for k in range(len(TERMS)))}),
    spans AS (SELECT e.doc_id, e.pos, e.begin, count(*) AS n FROM ends e JOIN places p ON p.doc_id = e.doc_id AND p.pos BETWEEN e.begin AND e.pos WHERE e.before IS NULL OR e.before < e.begin GROUP BY ALL)
    SELECT doc_id, round(sum(0.1::DOUBLE / (2 + pos - begin - n)), 9) AS rank FROM spans GROUP BY doc_id""")
def search_covers(spark, d):
    """The same documents, ranked by cover density."""
    return Q.matches(Q.index(read(spark, d, "documents"), "doc_id", "text"), ASKED, cover=True)


@query(f"WITH {SQL_RANKS} SELECT doc_id, rank, source FROM ranks JOIN documents USING (doc_id) WHERE lang IN ('en', 'de') ORDER BY rank DESC, n_chars DESC, doc_id LIMIT 20")
def fulltext_search(spark, d):
    """The first page of twenty (the operator's feature) of English and German documents, from a stored index."""
    docs = read(spark, d, "documents")
    path = f"{shared_path(spark)}/fulltext_{uuid.uuid4().hex}"
    Q.save_index(Q.index(docs, "doc_id", "text"), path)
    return Q.search(Q.load_index(spark, path), ASKED, docs.select("doc_id", "lang", "source", "n_chars"), lang=["en", "de"], created="n_chars").select("doc_id", "rank", "source")


@query(rf"WITH tokens AS (SELECT DISTINCT 0 AS doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+')) AS w, 0 AS i FROM documents), {sql_stems()} SELECT stem AS term, count(*) AS n FROM stems GROUP BY stem")
def stems(spark, d):
    """How many words of the documents have each stem."""
    docs = read(spark, d, "documents")
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("text")).distinct()
    return Q.index(words.withColumn("doc_id", F.monotonically_increasing_id()), "doc_id", "text").groupBy("term").agg(F.count("*").alias("n"))
