"""Tables out of replies: a polymorphic table function whose columns follow from the kind of rows that is asked for.

``reply_rows(reply, kind)`` gives a row for each record of the reply's array, with ids and defaults; a reply that can't
be read gives none. Register it with ``register`` and use it in a lateral join."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from docketlake.dictionaries import SOURCE_TYPES, UPDATE_FREQUENCIES
from docketlake.shipping import ship_package

#: Columns by kind (fixed values): portals of jurisdictions, sources of a site.
KINDS = {
    "portals": {"name": "string", "url": "string", "jurisdiction": "string", "agency": "string", "publication_types": "array<string>", "update_frequency": "string", "feed_availability": "string"},
    "sources": {"source_id": "string", "name": "string", "url": "string", "source_type": "string", "update_frequency": "string", "confidence": "double", "content_types": "array<string>", "feed_url": "string", "feed_format": "string"},
}
TYPES = {"string": T.StringType(), "double": T.DoubleType(), "array<string>": T.ArrayType(T.StringType())}


def records(reply: str | None) -> list[dict]:
    """The records of the array in a reply, or in its list ``discovered_sources``, whatever stands around it."""
    text = reply or ""
    for begin, end in (("[", "]"), ("{", "}")):
        a, b = text.find(begin), text.rfind(end)
        if begin == "[" and 0 <= text.find("{") < a:
            continue  # an object that holds the array
        try:
            found = json.loads(text[a : b + 1]) if 0 <= a < b else None
        except ValueError:
            found = None
        if isinstance(found, dict):
            found = found.get("discovered_sources")
        if isinstance(found, list):
            return [x for x in found if isinstance(x, dict)]
    return []


def source_row(x: dict) -> tuple | None:
    """A source of a site: id of name and address; a daily listing, .7 sure, unless it says another known kind, frequency or
    confidence; None without name and address."""
    name, url = x.get("source_name"), x.get("source_url")
    if not name or not url:
        return None
    kind, often = x.get("source_type") or "daily_listing", x.get("update_frequency")
    return (
        hashlib.md5(f"{name}_{url}".encode()).hexdigest()[:12], str(name), str(url), kind if kind in SOURCE_TYPES else "daily_listing", often if often in UPDATE_FREQUENCIES else "daily", float(x.get("confidence", 0.7)), [str(c) for c in x.get("content_types") or ["regulations"]],
        str(url) if "feed" in kind else None, x.get("feed_format"),
    )


def portal_row(x: dict) -> tuple | None:
    """A portal, as it is given; None without name and address."""
    if not x.get("name") or not x.get("url"):
        return None
    return tuple([str(t) for t in x.get(k) or []] if kind == "array<string>" else x.get(k) for k, kind in KINDS["portals"].items())


class ReplyRows:
    @staticmethod
    def analyze(reply: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        if kind.value not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        return AnalyzeResult(T.StructType([T.StructField(k, TYPES[t]) for k, t in KINDS[kind.value].items()]))

    def eval(self, reply: str, kind: str) -> Iterator[tuple]:
        for x in records(reply):
            row = source_row(x) if kind == "sources" else portal_row(x)
            if row is not None:
                yield row


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.udtf.register("reply_rows", udtf(ReplyRows))
