"""Assessments composed of weighted conditions: extractions, pages, sites, validations. Column expressions.

Flags are boolean columns; null counts as false. Counts are numbers; null counts as 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlake import dictionaries as D
from docketlake.functions.scoring import above, points, ratio, tier
from docketlake.functions.text import total


def n(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def mean(*scores: Column) -> Column:
    return total(list(scores)) / len(scores)


def listed(*entries: tuple[Column, str]) -> Column:
    """The words whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(flag(c), F.lit(w)) for c, w in entries]))


def any_has(issues: Column, word: str) -> Column:
    return F.exists(issues, lambda i: F.lower(i).contains(word))


# extracted records
def record_completeness(has_title: Column, n_chars: Column, known_authority: Column, has_ids: Column, has_dates: Column, n_sections: Column, n_counted: Column) -> Column:
    """Title, content, authority, identifiers, dates, sections, and sections counted in the metadata."""
    return points((flag(has_title), 0.15), (n(n_chars) > 500, 0.25), (flag(known_authority), 0.10), (flag(has_ids), 0.10), (flag(has_dates), 0.10), (n(n_sections) > 0, 0.20), (n(n_counted) > 0, 0.10), cap=None)


def record_issues(has_title: Column, n_chars: Column, n_sections: Column, known_authority: Column, has_ids: Column, known_type: Column) -> Column:
    return listed((~flag(has_title), "missing_title"), (n(n_chars) < 100, "insufficient_content"), (n(n_sections) == 0, "no_structured_sections"), (~flag(known_authority), "unknown_authority"), (~flag(has_ids), "missing_identifiers"), (~flag(known_type), "unidentified_document_type"))


def structure_clarity(has_hierarchy: Column, n_sections: Column, has_toc: Column, has_breadcrumbs: Column, n_structured: Column) -> Column:
    return points((flag(has_hierarchy), 0.3), (n(n_sections) > 0, 0.2), (flag(has_toc), 0.2), (flag(has_breadcrumbs), 0.15), (n(n_structured) > 0, 0.15))


def content_completeness(has_title: Column, n_sections: Column, n_metadata: Column, has_references: Column, has_abstract: Column) -> Column:
    return points((flag(has_title), 0.2), (n(n_sections) > 0, 0.3), (n(n_metadata) > 3, 0.2), (flag(has_references), 0.15), (flag(has_abstract), 0.15))


def metadata_quality(names: Column, indicators: list[str] = D.METADATA_INDICATORS) -> Column:
    """Share of the indicators that any name of the metadata holds."""
    held = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda k: F.lower(k))
    return total([F.exists(held, (lambda w: lambda k: k.contains(w))(w)).cast("int") for w in indicators]) / len(indicators)


def extraction_confidence(structure: Column, content: Column, metadata: Column) -> Column:
    return 0.4 * structure + 0.4 * content + 0.2 * metadata


def extraction_quality(has_title: Column, n_chars: Column, n_metadata: Column, has_structure: Column, has_ids: Column, has_dates: Column) -> Column:
    """Completeness, level, issues and advice of an extraction."""
    score = points((flag(has_title), 0.15), (n(n_chars) > 500, 0.25), (n(n_metadata) > 3, 0.20), (flag(has_structure), 0.20), (flag(has_ids), 0.10), (flag(has_dates), 0.10), cap=None)
    rounded = F.round(score, 6)
    return F.struct(
        rounded.alias("score"), tier(rounded, [(0.9, "excellent"), (0.75, "good"), (0.6, "fair")], "poor").alias("level"),
        listed((~flag(has_title), "Missing document title"), (n(n_chars) < 100, "Insufficient content extracted"), (n(n_metadata) < 2, "Limited metadata available")).alias("issues"),
        listed((rounded < 0.7, "Consider alternative extraction methods"), (~flag(has_structure), "Improve structure detection and parsing")).alias("advice"))


def static_confidence(n_words: Column, title: Column, n_headings: Column, n_paragraphs: Column) -> Column:
    s = above(n(n_words), [(1000, 0.4), (500, 0.3), (100, 0.2)])
    return s + points((F.length(F.coalesce(title, F.lit(""))) > 10, 0.2), (n(n_headings) > 2, 0.2), (n(n_paragraphs) > 3, 0.2), cap=None)


def dynamic_confidence(static: Column, rendered: Column, dynamic: Column) -> Column:
    return F.least(F.lit(1.0), static + points((flag(rendered), 0.1), (flag(dynamic), 0.1), cap=None))


def pdf_quality(success: Column, n_pages: Column, n_chars: Column, method: Column, extractable: Column, n_regulations: Column) -> Column:
    """Score, level, issues and whether a review by hand is needed."""
    density = ratio(n(n_chars).cast("double"), n(n_pages))
    fits = ((method == "text") & F.coalesce(extractable, F.lit(True))) | ((method == "ocr") & ~F.coalesce(extractable, F.lit(True)))
    raw = F.round(points((flag(success), 0.3), ((n(n_pages) > 0) & (density > 500), 0.2), ((n(n_pages) > 0) & (density > 100) & (density <= 500), 0.1), (flag(fits), 0.2), (n(n_regulations) > 0, 0.3), (n(n_regulations) > 5, 0.1), cap=None), 6)
    return F.struct(
        F.least(F.lit(1.0), raw).alias("score"), tier(raw, [(0.8, "excellent"), (0.6, "good"), (0.4, "fair")], "poor").alias("level"),
        listed((~flag(success), "text extraction failed"), ((n(n_pages) > 0) & (density <= 100), "low text density"), (~flag(fits), "unsuitable method"), (n(n_regulations) == 0, "no structured regulations")).alias("issues"),
        (raw < 0.5).alias("manual_review"), tier(raw, [(0.7, "high"), (0.4, "medium")], "low").alias("confidence"))


# pages and sites
def extraction_readiness(n_keywords: Column, hierarchical: Column, structured_tables: Column, n_search_forms: Column, n_documents: Column) -> Column:
    organisation = points((flag(hierarchical), 0.5), (flag(structured_tables), 0.3), (n(n_search_forms) > 0, 0.2))
    s = 0.4 * F.least(F.lit(1.0), n(n_keywords) / 20.0) + 0.35 * organisation + 0.25 * F.least(F.lit(1.0), n(n_documents) / 10.0)
    return F.least(F.lit(1.0), s)


def technical_complexity(n_scripts: Column, frameworks: Column, dynamic: Column) -> Column:
    has = lambda *names: reduce(lambda a, b: a | b, [F.array_contains(frameworks, x) for x in names])
    framework = F.when(has("react", "angular"), 0.3).when(has("vue"), 0.2).when(has("jquery"), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), above(n(n_scripts), [(10, 0.4), (5, 0.2)]) + framework + F.when(flag(dynamic), 0.3).otherwise(0.0))


def analysis_confidence(n_chars: Column, n_keywords: Column, technical_ok: Column) -> Column:
    return mean(above(n(n_chars), [(10_000, 0.9), (1_000, 0.7)], 0.4), above(n(n_keywords), [(10, 0.9), (5, 0.7)], 0.5), F.when(flag(technical_ok), 0.8).otherwise(0.4))


def extraction_advice(n_scripts: Column, n_pdf: Column, hierarchical: Column, allowed: Column, delay: Column) -> Column:
    """Methods, tools, challenges and the estimated success rate of a site."""
    scripted, pdf, plain = n(n_scripts) > 10, n(n_pdf) > 5, flag(hierarchical) & ~(n(n_scripts) > 10)
    barred = ~F.coalesce(allowed, F.lit(True))
    rate = points((plain, 0.4), (scripted, 0.3), (pdf, 0.2), cap=None) * F.when(barred, 0.7).otherwise(1.0)
    return F.struct(
        listed((plain, "html_parsing"), (scripted, "browser_automation")).alias("primary"), listed((pdf, "pdf_extraction")).alias("secondary"), listed((scripted, "playwright"), (pdf, "pdf_processing")).alias("tools"),
        listed((scripted, "JavaScript dependency"), (barred, "Robots.txt restrictions"), (n(delay) > 5, "Long crawl delay")).alias("challenges"), F.round(rate, 6).alias("success_rate"))


def html_readiness(n_semantic: Column, n_headings: Column, has_nav_and_main: Column, n_lists: Column, n_tables: Column, has_time: Column) -> Column:
    return points((n(n_semantic) > 0, 0.3), (n(n_headings) > 2, 0.2), (flag(has_nav_and_main), 0.2), (n(n_lists) > 0, 0.1), (n(n_tables) > 0, 0.1), (flag(has_time), 0.1))


def pdf_readiness(n_pdf: Column, n_links: Column) -> Column:
    return F.least(F.lit(1.0), 2.0 * ratio(n(n_pdf), n(n_links)))


def ocr_need(n_images: Column, n_canvases: Column, n_pdf_embeds: Column) -> Column:
    return points((n(n_images) > 5, 0.3), (n(n_canvases) > 0, 0.4), (n(n_pdf_embeds) > 0, 0.3))


def site_complexity(depth: Column, n_chars: Column, n_scripts: Column, n_long_tables: Column) -> Column:
    part = lambda c, most: F.least(F.lit(1.0), n(c) / float(most))
    return mean(part(depth, 20), part(n_chars, 50_000), part(n_scripts, 20), part(n_long_tables, 5))


def site_confidence(n_chars: Column, has_title_and_nav: Column, semantic: Column, has_legal_words: Column) -> Column:
    pick = lambda c, yes, no: F.when(flag(c), yes).otherwise(no)
    return mean(above(n(n_chars), [(10_000, 0.9), (1_000, 0.7)], 0.4), pick(has_title_and_nav, 0.8, 0.5), pick(semantic, 0.8, 0.6), pick(has_legal_words, 0.9, 0.5))


def recommended_methods(pdf_ratio: Column, image_share: Column, accessibility: Column, complex_tables: Column, scripted: Column) -> Column:
    return listed((F.lit(True), "html_parsing"), (n(pdf_ratio) > 0.1, "pdf_extraction"), ((n(image_share) > 0.2) | (n(accessibility) < 0.5), "ocr"), (flag(complex_tables), "computer_vision"), (flag(scripted), "hybrid"))


def content_shares(**counts: Column) -> Column:
    """Share of each kind of content, of at least one."""
    every = F.greatest(F.lit(1), total([n(c) for c in counts.values()]))
    return F.struct(*((n(c) / every).alias(k) for k, c in counts.items()))


def feasibility(legal: Column, quality: Column, complexity: Column, allowed: Column, restricted: Column, structure: Column, delay: Column) -> Column:
    """Content, access, permission, structure and delay."""
    permission = F.when(F.coalesce(allowed, F.lit(True)), F.when(flag(restricted), 0.14).otherwise(0.20)).otherwise(0.0)
    speed = F.when(n(delay) <= 1, 0.10).when(n(delay) <= 5, 0.05).otherwise(0.02)
    s = 0.3 * (0.6 * n(legal) + 0.4 * n(quality)) + 0.25 * (1.0 - F.least(F.coalesce(complexity, F.lit(1.0)), F.lit(1.0))) + permission + 0.15 * n(structure) + speed
    return F.least(F.lit(1.0), s)


def final_advice(complexity: Column, n_pdf: Column, allowed: Column) -> Column:
    automated = n(complexity) > 0.7
    return F.struct(F.when(automated, "browser_automation").otherwise("html_parsing").alias("method"), listed((n(n_pdf) > 10, "pdf_extraction")).alias("fallbacks"), F.when(automated, 4).otherwise(2).alias("hours"), listed((~F.coalesce(allowed, F.lit(True)), "Robots.txt restrictions detected")).alias("considerations"))


def analysis_completeness(*successes: Column) -> Column:
    return total([flag(s).cast("int") for s in successes]) / len(successes)


def data_quality(n_chars: Column, legal: Column, n_structures: Column) -> Column:
    return F.least(F.lit(1.0), above(n(n_chars), [(10_000, 0.3), (1_000, 0.2)]) + 0.4 * n(legal) + 0.3 * F.least(n(n_structures) / 4.0, F.lit(1.0)))


def cms(html: Column, patterns: dict[str, list[str]] = D.CMS) -> Column:
    """The first system of which a pattern is found in the lower-cased page."""
    low, out = F.lower(html), None
    for name, found in patterns.items():
        hit = reduce(lambda a, b: a | b, [low.rlike(p) for p in found])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def libraries(sources: Column, words: dict[str, list[str]] = D.LIBRARIES) -> Column:
    """Distinct libraries, one for each script's address: the first whose word it holds."""
    def label(src: Column) -> Column:
        out = None
        for name, found in words.items():
            hit = reduce(lambda a, b: a | b, [F.lower(src).contains(w) for w in found])
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(sources, label))))


def server_technology(headers: Column) -> Column:
    """What the headers (a map with lower-case names) tell."""
    get = lambda k: F.nullif(F.try_element_at(headers, F.lit(k)), F.lit(""))
    low = F.lower(get("server"))
    kind = F.when(low.contains("apache"), "Apache").when(low.contains("nginx"), "Nginx").when(low.contains("iis"), "IIS")
    behind = reduce(lambda a, b: a | b, [F.map_contains_key(headers, F.lit(h)) for h in D.CDN_HEADERS])
    return F.struct(get("server").alias("server"), kind.alias("web_server"), get("x-powered-by").alias("powered_by"), get("x-aspnet-version").alias("aspnet_version"), flag(behind).alias("cdn"))


def text_jurisdiction(text: Column, url: Column, words: dict[str, list[str]] = D.TEXT_JURISDICTIONS) -> Column:
    """By host (a .gov host is tested before .gov.au, as the fixed order has it), else by words; with its confidence."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))
    has = lambda *parts: reduce(lambda a, b: a | b, [host.contains(p) for p in parts])
    found = F.when(has(".gov.uk", "parliament.uk"), "uk").when(has(".europa.eu", ".eur-lex.europa.eu"), "eu").when(has(".gov"), "us").when(has(".gc.ca"), "canada").when(has(".gov.au"), "australia")
    scores = {k: total([text.contains(w).cast("int") for w in ws]) for k, ws in words.items()}
    held = F.array_compact(F.array(*[F.when(s > 0, F.struct(F.lit(k).alias("key"), s.alias("value"))) for k, s in scores.items()]))
    return F.struct(found.alias("jurisdiction"), F.map_from_entries(held).alias("words"), F.when(found.isNotNull(), 0.9).when(F.size(held) > 0, 0.7).otherwise(0.3).alias("confidence"))


def legal_structure(text: Column, n_headings: Column, n_definitions: Column, n_tables: Column) -> Column:
    """Three or more of five signs of a legal document."""
    formal = reduce(lambda a, b: a | b, [F.lower(text).contains(w) for w in D.FORMAL_PHRASES])
    signs = (text.rlike(r"(?U)\b\d+\.\s"), n(n_headings) >= 3, n(n_definitions) > 0, n(n_tables) > 0, formal)
    return total([flag(s).cast("int") for s in signs]) >= 3


# validations
def structure_score(missing: Column, duplicates: Column, many_short: Column, n_sections: Column) -> Column:
    """1 less .05 for each missing field, .1 for repeated numbers, .1 for many short sections; 0 without sections."""
    s = 1.0 - 0.05 * n(missing) - F.when(flag(duplicates), 0.1).otherwise(0.0) - F.when(flag(many_short), 0.1).otherwise(0.0)
    return F.when(n(n_sections) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), s))


def consistency_score(n_count_differences: Column, n_unlike: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - 0.2 * n(n_count_differences) - 0.1 * n(n_unlike))


def coherence_score(n_abrupt: Column, regulatory_share: Column, n_sections: Column) -> Column:
    s = 1.0 - 0.05 * n(n_abrupt) - F.when(n(regulatory_share) < 0.3, 0.2).otherwise(0.0)
    return F.when(n(n_sections) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), s))


ADVICE = {
    "completeness": ([("coverage", "Review extraction method to capture more source content"), ("missing", "Enhance extraction to capture missing document sections"), ("short", "Verify extraction captured full content, not just summaries")], "Review and improve content extraction process"),
    "citation": ([("format", "Standardize legal citation formats"), ("reference", "Verify and repair broken cross-references")], "Improve citation extraction and validation"),
    "structure": ([("missing", "Enhance extraction to capture missing structural elements"), ("duplicate", "Review section numbering and remove duplicates"), ("short", "Investigate unusually short sections for extraction errors")], "Improve content structure extraction"),
    "consistency": ([("count", "Investigate extraction method differences"), ("similarity", "Cross-validate content across extraction methods")], "Review extraction consistency across methods"),
    "coherence": ([("coherence", "Review section ordering and logical flow"), ("regulatory", "Verify source contains regulatory content")], "Improve semantic analysis of extracted content"),
}  # fixed values: a component's words and the advice for them, and the advice where none is found


def component_advice(issues: Column, component: str) -> Column:
    known, other = ADVICE[component]
    found = listed(*((any_has(issues, w), advice) for w, advice in known))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(other)))


def quality_summary(score: Column, n_issues: Column) -> Column:
    return (
        F.when((score >= 0.8) & (n_issues <= 2), "High quality extraction with minimal issues. Content is ready for use.")
        .when((score >= 0.6) & (n_issues <= 5), "Good quality extraction with some minor issues. Review recommended before use.")
        .when(score >= 0.4, "Moderate quality extraction with several issues. Manual review required.")
        .otherwise("Low quality extraction with significant issues. Re-extraction recommended.")
    )


def overall_quality(scores: Column, issues: Column, advice: Column) -> Column:
    """The report over components: mean score (0 without any), confidence, issues (ten at most), advice, review."""
    count = F.size(scores)
    score = F.round(F.when(count == 0, 0.0).otherwise(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / count), 6)
    critical = F.size(F.filter(issues, lambda i: F.lower(i).rlike("missing|failed|broken")))
    return F.struct(
        score.alias("score"), tier(score, [(0.8, "high"), (0.5, "medium")], "low").alias("confidence"), F.size(issues).alias("n_issues"), critical.alias("n_critical"), F.slice(issues, 1, 10).alias("issues"),
        F.array_sort(F.array_distinct(F.slice(advice, 1, 10))).alias("advice"), quality_summary(score, F.size(issues)).alias("summary"), ((score < 0.6) | (F.size(issues) > 5)).alias("manual_review"))
