"""Records of regulations, sources and targets: identifiers, dates, titles, structure, listings, stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake import dictionaries as D
from docketlake.functions.text import engine_form
from docketlake.operators.ordered import running

def targets(spark, entries: list[tuple[str, str, str, str]] = D.COMMON_TARGETS) -> DataFrame:
    """Monitoring targets as they are set up: id, name, url, website_type, monitoring_frequency, not checked yet."""
    return added_targets(spark.createDataFrame(entries, "name string, url string, website_type string, monitoring_frequency string"))


def target_id(name: Column, url: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", name, url)), 1, 12)


def added_targets(entries: DataFrame) -> DataFrame:
    """New targets with their ids; how often, where it isn't said, is daily."""
    often = F.coalesce(F.col("monitoring_frequency"), F.lit("daily"))
    none = F.lit(None).cast("string")
    return entries.select(
        target_id(F.col("name"), F.col("url")).alias("id"), "name", "url", "website_type", often.alias("monitoring_frequency"), F.array().cast("array<string>").alias("change_indicators"),
        F.lit(None).cast("timestamp").alias("last_checked"), none.alias("last_content_hash"), none.alias("baseline_content"), F.lit("content_hash").alias("change_detection_strategy"))


def display_title(record_id: Column, title: Column) -> Column:
    return F.when(F.coalesce(record_id, F.lit("")) != "", F.concat(record_id, F.lit(": "), title)).otherwise(title)


def keys_with(metadata: Column, *words: str) -> Column:
    """The entries of a map whose name holds any of the words."""
    return F.map_filter(metadata, lambda k, v: F.lower(k).rlike("|".join(words)))


def identifiers(metadata: Column, title: Column) -> Column:
    """Entries that name an identifier, and the title's number as primary_id."""
    named = keys_with(metadata, "id", "number", "identifier", "reference")
    number = F.coalesce(*[F.nullif(F.regexp_extract(title, engine_form(p, True), 0), F.lit("")) for p in D.TITLE_NUMBERS])
    return F.when(number.isNotNull(), F.map_zip_with(named, F.create_map(F.lit("primary_id"), number), lambda k, a, b: F.coalesce(b, a))).otherwise(named)


def date_entries(metadata: Column, found: Column) -> Column:
    """Entries that name a date, and the first five dates of the text."""
    return F.struct(keys_with(metadata, "date").alias("named"), F.slice(found, 1, 5).alias("extracted"))


def authority(metadata: Column, section_titles: Column) -> Column:
    """publisher ▸ author ▸ Unknown, and the first section title of a department or ministry."""
    get = lambda k: F.nullif(F.try_element_at(metadata, F.lit(k)), F.lit(""))
    return F.struct(F.coalesce(get("publisher"), get("author"), F.lit("Unknown")).alias("name"), F.get(F.filter(section_titles, lambda t: F.lower(t).rlike("department|ministry")), 0).alias("department"))


def title_type(title: Column, hint: Column) -> Column:
    """By the title's words, in their order, else the hint, else other."""
    low = F.lower(title)
    return F.coalesce(*[F.when(low.contains(k), k) for k in ("regulation", "act", "bill", "directive")], F.nullif(hint, F.lit("")), F.lit("other"))


def record_jurisdiction(content: Column, hint: Column) -> Column:
    """The hint, else by the content's phrases in their order, else other."""
    low = F.lower(content)
    by_phrase = [F.when(low.rlike("|".join(phrases)), k) for k, phrases in D.RECORD_JURISDICTIONS.items()]
    return F.coalesce(F.nullif(hint, F.lit("")), *by_phrase, F.lit("other"))


def record_status(content: Column) -> Column:
    """By the content's words in their order, else enacted."""
    low = F.lower(content)
    return F.coalesce(*[F.when(low.rlike("|".join(words)), k) for k, words in D.RECORD_STATUS_WORDS.items()], F.lit("enacted"))


def formatted(title: Column, abstract: Column, sections: Column) -> Column:
    """Title, abstract and sections (title, content) in blocks parted by empty lines."""
    blocks = F.concat(F.array(F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("Title: "), title)), F.when(F.coalesce(abstract, F.lit("")) != "", F.concat(F.lit("Abstract: "), abstract))), F.transform(sections, lambda s: F.concat(F.lit("Section: "), s["title"], F.lit("\n"), s["content"])))
    return F.array_join(F.array_compact(blocks), "\n\n")


def outline(sections: Column, references: Column) -> Column:
    """Titles with the head of each section, and how many references there are."""
    return F.struct(F.transform(sections, lambda s: F.struct(s["title"].alias("title"), F.left(s["content"], F.lit(200)).alias("summary"))).alias("sections"), F.size(references).alias("n_references"))


def with_hints(derived: Column, hints: Column) -> Column:
    """A map with the entries of the hints over its own."""
    return F.map_zip_with(derived, F.coalesce(hints, F.create_map().cast("map<string,string>")), lambda k, a, b: F.coalesce(b, a))


def trimmed_distinct(values: Column, low: int = 3, high: int = 200) -> Column:
    """Values without white space at their ends, of fitting length, each once, in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: F.length(v).between(low, high)))


def added(values: Column, value: Column) -> Column:
    """The values with one more, unless it is among them."""
    return F.array_union(F.coalesce(values, F.array().cast("array<string>")), F.array(value))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_timestamp(end) - F.unix_timestamp(start)).cast("long")


def with_error(errors: Column, at: Column, message: Column) -> Column:
    return F.array_append(F.coalesce(errors, F.array().cast("array<string>")), F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(": "), message))


def expired(expiry: Column, today: Column) -> Column:
    return F.coalesce(expiry < today, F.lit(False))


def current_status(dates: Column, check: Column) -> Column:
    """In force from the first effective date, or else the first publication; expired from the first expiry. ``dates``:
    array of (kind, date), in order."""
    first = lambda kind: F.get(F.filter(dates, lambda d: d["kind"] == kind), 0)["date"]
    start, end = F.coalesce(first("effective"), first("publication")), first("expiry")
    return F.when(check >= end, "expired").when(check >= start, "in_force").when(start.isNotNull(), "not_yet_in_force").otherwise("unknown")


def by_discovery(sources: DataFrame, since: Column, limit: int = 50) -> DataFrame:
    """The listing of sources found since a time: the newest first, as the time is shown; ``limit`` of them."""
    return sources.where(F.col("discovered_date") >= since).orderBy(F.date_format("discovered_date", "yyyy-MM-dd HH:mm").desc(), "source_id").limit(limit)


def newest_sources(sources: DataFrame, n: int = 10) -> DataFrame:
    return sources.orderBy(F.desc("discovered_date"), "source_id").limit(n)


def distinct_places(sources: DataFrame) -> DataFrame:
    return sources.agg(F.countDistinct("jurisdiction").alias("jurisdictions"), F.countDistinct("agency").alias("agencies"), F.count("*").alias("total"))


def optimised(patterns: DataFrame, uses: DataFrame, min_uses: int = 5) -> DataFrame:
    """Patterns (pattern_id, confidence, avg_items, success_rate) after the recent uses (pattern_id, n, items): used ones
    gain min(.1, .01 of their mean items), up to 1, and average their items; ones that failed over .7 of more than
    ``min_uses`` are deprecated. The score weighs rate, uses and items."""
    joined = patterns.join(uses, "pattern_id", "left")
    mean = F.col("items") / F.col("n")
    used = F.coalesce(F.col("n") > 0, F.lit(False))
    score = 0.6 * F.col("success_rate") + 0.2 * (F.coalesce("n", F.lit(0)) / 100) + 0.2 * (F.coalesce(mean, F.lit(0.0)) / 10)
    return joined.select(
        "pattern_id", F.round(F.when(used, F.least(F.lit(1.0), F.col("confidence") + F.least(F.lit(0.1), 0.01 * mean))).otherwise(F.col("confidence")), 6).alias("confidence"),
        F.round(F.when(used, (F.col("avg_items") + mean) / 2).otherwise(F.col("avg_items")), 6).alias("avg_items"), F.round(score, 6).alias("score"), F.coalesce((F.col("success_rate") < 0.3) & (F.col("n") > min_uses), F.lit(False)).alias("deprecated"))


def drill_down(categories: DataFrame, page: str, order: str, n: int = 10) -> DataFrame:
    """Of each page's first ``n`` categories those that need it and have a valid address."""
    place = F.row_number().over(Window.partitionBy(page).orderBy(order))
    return categories.withColumn("_n", place).where((F.col("_n") <= n) & F.col("needs_drill_down") & F.col("url").rlike(r"^https?://[^/?#\s]+")).drop("_n")


def text_layout(text: Column) -> Column:
    """Lines of a recognised text as table rows (three tokens and more), form fields (key: value) and list items; score."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = F.filter(lines, lambda x: F.size(F.split(x, r"\s+")) >= 3)
    fields = F.filter(lines, lambda x: x.contains(":") & (F.length(F.split_part(x, F.lit(":"), F.lit(1))) < 50) & (F.trim(F.regexp_replace(x, "^[^:]*:", "")) != ""))
    items = F.filter(lines, lambda x: x.rlike(r"^(?:[•·*-]|[0-9]+[.)])\s*"))
    score = F.when(F.size(rows) > 0, 0.3).otherwise(0.0) + F.when(F.size(fields) > 0, 0.3).otherwise(0.0) + F.when(F.size(items) > 0, 0.2).otherwise(0.0)
    return F.struct(F.size(rows).alias("table_rows"), F.size(fields).alias("fields"), F.size(items).alias("items"), F.round(score, 6).alias("score"))


def backed_up(df: DataFrame, folder: str, stamp: str) -> DataFrame:
    """Write a store beside itself before it is cleared; gives the cleared store."""
    df.write.mode("errorifexists").parquet(f"{folder}/backup_{stamp}")
    return df.limit(0)


# lookups, states and reports
def looked_up(rows: DataFrame, table: DataFrame, key: str, column: str, default: str = "unknown") -> DataFrame:
    """``rows`` with a column of ``table``; the default where the key is missing there."""
    side = table.select(key, F.col(column).alias("_found"))
    return rows.join(side, key, "left").withColumn(column, F.coalesce("_found", F.lit(default))).drop("_found")


def named_only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of the given ids; ids without a row are skipped."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def reinforced_patterns(patterns: DataFrame, used: DataFrame) -> DataFrame:
    """Patterns (source_id, pattern_id, success_count) after their uses: those named gain one each."""
    hits = used.groupBy("pattern_id").agg(F.count("*").alias("_n"))
    return patterns.join(hits, "pattern_id", "left").withColumn("success_count", F.col("success_count") + F.coalesce("_n", F.lit(0))).drop("_n")


def fast_sessions(sessions: DataFrame, by: str, order: list[str], n: int = 5, least: int = 5, seconds: float = 30.0) -> DataFrame:
    """Of each source's last ``n`` successful sessions those that found enough in time."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*[F.desc(o) for o in order]))
    return sessions.where("success").withColumn("_n", place).where((F.col("_n") <= n) & (F.col("items") >= least) & (F.col("seconds") < seconds)).drop("_n")


def manual_sources(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Sources added by hand: id of agency, type and the number of sources before them; full confidence."""
    before = existing.agg(F.count("*")).scalar()
    numbered = running(rows, [], ["name"], "_place")
    return numbered.withColumn("source_id", F.concat_ws("_", F.lower("agency"), "source_type", (before + F.col("_place") - 1).cast("string"))).withColumn("confidence", F.lit(1.0)).drop("_place")


def validated_source(items: DataFrame, by: str) -> DataFrame:
    """Per source, from its sampled items: the share that has a title and an address, and when it was checked."""
    good = (F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "")
    return items.groupBy(by).agg(F.round(F.count_if(good) / F.count("*"), 6).alias("success_rate"), F.max("discovered_date").alias("last_checked"))


def analysed(items: DataFrame, replies: DataFrame) -> DataFrame:
    """Items with the scores of their analyses, as processed; those without one stay as they are."""
    r = replies.select("item_id", F.from_json("reply", "struct<relevance:double,item_type:string>").alias("_r"))
    rows = items.join(r, "item_id", "left")
    found = F.col("_r").isNotNull()
    return rows.withColumns({"relevance_score": F.coalesce(F.col("_r.relevance"), "relevance_score"), "item_type": F.coalesce(F.col("_r.item_type"), "item_type"), "status": F.when(found, "processed").otherwise(F.col("status"))}).drop("_r")


def touched(before: DataFrame, after: DataFrame, key: str, now: Column) -> DataFrame:
    """``after`` with updated_at: now for rows that are new or differ from ``before``, else the time that they had."""
    columns = [c for c in after.columns if c not in (key, "updated_at")]
    mark = lambda df: df.select(key, F.xxhash64(*columns).alias("_mark"), "updated_at")
    old = mark(before).withColumnsRenamed({"_mark": "_old", "updated_at": "_was"})
    rows = after.drop("updated_at").withColumn("_mark", F.xxhash64(*columns)).join(old, key, "left")
    return rows.withColumn("updated_at", F.when(F.col("_old") == F.col("_mark"), F.col("_was")).otherwise(now)).drop("_mark", "_old", "_was")


def category_counts(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """How many rows each value of a closed domain has; 0 where none."""
    wanted = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return wanted.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").fillna(0, ["n"])


def image_sequence(pages: DataFrame, by: str, order: str) -> DataFrame:
    """Recognised pages (text, confidence, success) of each document: merged text, success rate, level."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n\n")
    rate = F.round(F.count_if("success") / F.count("*"), 6)
    return pages.groupBy(by).agg(F.count("*").alias("n_pages"), text.alias("text"), rate.alias("success_rate"), F.round(F.avg("confidence"), 6).alias("confidence")).withColumn("quality", F.when(F.col("success_rate") > 0.9, "high").when(F.col("success_rate") > 0.7, "medium").otherwise("low"))


def document_facts(text: Column) -> Column:
    """Length, words, lines, and whether the text speaks of rules."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.length(t).alias("length"), F.regexp_count(t, F.lit(r"\S+")).alias("words"), F.size(F.split(t, "\n")).alias("lines"), F.lower(t).rlike("regulation|law|act|section|article").alias("regulatory"))


def improvement_report(rows: DataFrame, n: int = 5, errors: int = 3) -> DataFrame:
    """One row: extractions, successes, the first improvements and errors (the report's numbers)."""
    def first_of(column: str, k: int) -> Column:
        held = rows.where(F.col(column).isNotNull()).orderBy("place").limit(k).agg(F.array_sort(F.collect_list(F.struct("place", F.col(column).alias("t")))).alias("x"))
        return held.select(F.transform("x", lambda x: x["t"])).scalar()

    every = rows.agg(F.count("*").alias("extractions"), F.count_if("success").alias("successful"))
    return every.withColumns({"improvements": first_of("improvement", n), "errors": first_of("error", errors)})


def extraction_text(title: Column, url: Column, content: Column, limit: int = 2000) -> Column:
    """One extraction as text: title, address, and the head of its content."""
    head = F.when(F.length(content) > limit, F.concat(F.left(content, F.lit(limit)), F.lit("..."))).otherwise(F.coalesce(content, F.lit("")))
    return F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\nURL: "), F.coalesce(url, F.lit("")), F.lit("\n\n"), head)
