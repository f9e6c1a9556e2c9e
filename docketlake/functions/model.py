"""Where a language model's reply comes in: repairs of its JSON, and a rule scorer that stands in for it offline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlake.functions.text import best_label, presence_count

CATEGORIES = {"food": ["food", "feed", "hygiene"], "chemicals": ["chemical", "substance", "reach"], "electrical": ["electrical", "voltage", "battery"], "medical": ["medical", "medicine", "drug"], "transport": ["vehicle", "aviation", "rail"], "environment": ["emission", "waste", "pollution"]}
URGENT = ["recall", "ban", "prohibited", "immediate", "penalty"]
REPLY = "struct<category:string,confidence:double,impact:string>"


def json_part(reply: Column) -> Column:
    """The first object of a reply, without the fence around it."""
    bare = F.regexp_replace(F.trim(reply), r"^```[a-zA-Z]*\s*|\s*```$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def repaired(reply: Column, schema: str) -> Column:
    """The record of the first repair that parses: none, trailing commas, single quotes, bare keys."""
    def record(part: Column) -> Column:
        commas = F.regexp_replace(part, r",\s*([}\]])", "$1")
        quotes = F.regexp_replace(commas, "'", '"')
        keys = F.regexp_replace(quotes, r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)\s*:", '$1"$2":')
        return F.coalesce(*[F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, schema)) for x in (part, commas, quotes, keys)])

    return once(json_part(reply), record)


def once(value: Column, f) -> Column:
    """``f(value)`` with the value worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def rule_scorer(text: Column) -> Column:
    """A reply as the model would give it, from word lists alone."""
    n = presence_count(text, URGENT)
    impact = F.when(n >= 3, "critical").when(n == 2, "high").when(n == 1, "medium").otherwise("informational")
    label = best_label(text, CATEGORIES, "not_product_compliance")
    return once(label, lambda c: F.to_json(F.struct(c.alias("category"), F.when(c == "not_product_compliance", 0.5).otherwise(0.8).alias("confidence"), impact.alias("impact"))))


def classification(reply: Column) -> Column:
    """Category, confidence and impact of a reply; what is missing or unknown gets its default."""
    known = [*CATEGORIES, "not_product_compliance"]
    impacts = ["critical", "high", "medium", "low", "informational"]

    def checked(r: Column) -> Column:
        return F.struct(F.when(r["category"].isin(known), r["category"]).otherwise("not_product_compliance").alias("category"), F.coalesce(r["confidence"], F.lit(0.5)).alias("confidence"), F.when(r["impact"].isin(impacts), r["impact"]).otherwise("informational").alias("impact"))

    return once(repaired(reply, REPLY), checked)


def alerts(impact: Column, significance: Column) -> Column:
    return impact.isin("critical", "high") | (significance > 0.7)
