"""Stored collections as tables: sources and discovery sessions, feed items and monitoring sessions, targets and changes.

Each file is one JSON array. A missing or malformed file gives no rows. Every element that is an object with a known
field gives a row; what doesn't fit a field's type or closed domain is null there and stands, as it was, in ``unread``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake import dictionaries as D
from docketlake.sources.tables import timestamp

#: Fields of the stored records (fixed values). Nested values stay JSON text.
SCHEMAS = {
    "publication_sources": "source_id string, name string, url string, source_type string, jurisdiction string, agency string, discovered_date timestamp, discovery_method string, confidence_score double, update_frequency string, content_types array<string>, feed_url string, feed_format string, is_active boolean, last_checked timestamp, check_interval_hours int, publication_date_selectors array<string>, title_selectors array<string>, content_link_patterns array<string>, publications_found int, false_positive_rate double, extraction_success_rate double",
    "discovery_sessions": "session_id string, start_time timestamp, target_jurisdictions array<string>, discovery_methods array<string>, sources_discovered array<string>, total_urls_scanned int, successful_discoveries int, session_notes array<string>",
    "feed_items": "item_id string, source_id string, title string, url string, content_snippet string, published_date timestamp, discovered_date timestamp, item_type string, keywords array<string>, status string, extracted_content string, analysis_results string, relevance_score double, content_quality_score double, business_impact_score double",
    "monitoring_sessions": "session_id string, start_time timestamp, sources_checked int, feeds_processed int, items_discovered int, new_items int, errors_encountered int, session_duration_seconds double, session_notes array<string>",
    "monitoring_targets": "id string, name string, url string, website_type string, monitoring_frequency string, change_indicators array<string>, last_checked timestamp, last_content_hash string, baseline_content string, change_detection_strategy string",
    "change_history": "document_id string, url string, change_type string, change_date timestamp, previous_content_hash string, current_content_hash string, diff_summary string, change_details string, significance_score double, affected_sections array<string>, compliance_impact string",
}
DOMAINS = {"source_type": D.SOURCE_TYPES, "update_frequency": D.UPDATE_FREQUENCIES, "status": D.ITEM_STATUSES}


def in_domain(c: Column, values: list[str], default: str | None = None) -> Column:
    """The value if its domain has it, else the default."""
    return F.when(c.isin(values), c).otherwise(F.lit(default))


def fields(name: str) -> list[T.StructField]:
    return T.StructType.fromDDL(SCHEMAS[name]).fields


def raw_schema(name: str) -> T.StructType:
    """The collection's fields as text (lists as lists of text), so that no value is lost for its type."""
    return T.StructType([T.StructField(f.name, f.dataType if isinstance(f.dataType, T.ArrayType) else T.StringType()) for f in fields(name)])


def typed(rows: DataFrame, name: str) -> DataFrame:
    """Rows of text as the collection's types, with ``unread``: field and text of what doesn't fit."""
    out, unread = [], []
    for f in fields(name):
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType) or isinstance(f.dataType, T.StringType) and f.name not in DOMAINS:
            out.append(c)
            continue
        value = timestamp(c) if isinstance(f.dataType, T.TimestampType) else c.try_cast(f.dataType) if f.name not in DOMAINS else in_domain(c, DOMAINS[f.name])
        out.append(value.alias(f.name))
        unread.append(F.when(value.isNull() & (c != ""), F.struct(F.lit(f.name).alias("key"), c.alias("value"))))
    left = F.map_from_entries(F.array_compact(F.array(*unread))) if unread else F.create_map().cast("map<string,string>")
    return rows.where(F.coalesce(*[F.col(f.name).cast("string") for f in fields(name)]).isNotNull()).select(*out, left.alias("unread"))


def store(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The collection ``name`` at ``path`` (a file, a folder or a pattern)."""
    schema = raw_schema(name)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder):
        return typed(spark.createDataFrame([], schema), name)
    return typed(spark.read.schema(schema).option("multiLine", True).json(path), name)


def stored_records(texts: Column, name: str) -> Column:
    """The collection's fields of one record's JSON text, to be typed by ``typed``."""
    return F.from_json(texts, raw_schema(name))


def seen_items(spark: SparkSession, path: str) -> DataFrame:
    """(url, item_id) of a stored map of what was seen."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("url", "item_id"))


def settings(text: str | None) -> dict:
    """Settings of a YAML text of nested maps, lists and scalars; {} where it can't be read."""
    try:
        import yaml
    except ModuleNotFoundError:
        return plain_settings(text)
    try:
        return yaml.safe_load(text or "") or {}
    except yaml.YAMLError:
        return {}


def plain_settings(text: str | None) -> dict:
    """The same for maps and lists of scalars alone, by indentation, where no YAML reader is at hand."""
    out: dict = {}
    stack: list[tuple[int, dict]] = [(-1, out)]
    last: tuple[dict, str] | None = None
    for line in (text or "").splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        depth = len(bare) - len(bare.lstrip())
        word = bare.strip()
        if word.startswith("- "):
            if last is None:
                return {}
            held, key = last
            if not isinstance(held.get(key), list):
                held[key] = []
            held[key].append(scalar(word[2:]))
            continue
        key, colon, value = word.partition(":")
        if not colon:
            return {}
        while stack[-1][0] >= depth:
            stack.pop()
        here = stack[-1][1]
        here[key.strip()] = scalar(value) if value.strip() else {}
        last = (here, key.strip())
        if not value.strip():
            stack.append((depth, here[key.strip()]))
    return out


def scalar(word: str):
    word = word.strip().strip("'\"")
    if word.lower() in ("true", "false"):
        return word.lower() == "true"
    for kind in (int, float):
        try:
            return kind(word)
        except ValueError:
            pass
    return None if word in ("", "null", "~") else word


#: Settings that must be there, and their ranges (fixed values).
REQUIRED = ("database.host", "database.name", "redis.host", "openai.api_key")
LIMITS = {"database.port": (1, 65535), "redis.port": (1, 65535), "openai.temperature": (0.0, 2.0), "scraping.delay": (0, 60), "scraping.timeout": (1, 600), "scraping.retries": (0, 10), "extraction.max_documents": (1, 10_000)}


def setting(values: dict, name: str):
    for part in name.split("."):
        values = values.get(part) if isinstance(values, dict) else None
    return values


def settings_report(values: dict, required=REQUIRED, limits=LIMITS) -> tuple[list[str], list[str]]:
    """Errors (what is missing or out of range) and warnings (what is not set and takes its default)."""
    errors = [f"{name} is required" for name in required if setting(values, name) in (None, "")]
    warnings = []
    for name, (low, high) in limits.items():
        value = setting(values, name)
        if value is None:
            warnings.append(f"{name} is not set")
        elif isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value <= high:
            errors.append(f"{name} must be between {low} and {high}")
    return errors, warnings
