"""Secret scans: base patterns, and opaque strings that a battery of randomness tests takes for random. Column
expressions only.

A candidate is a run of 20 or more characters of base64 (either form) with a letter in it. Its encoding is inferred
from its characters: hex digits in one case, base32, else base64. The battery asks whether it was drawn evenly from
that alphabet: chi-squared over symbols, chi-squared over classes of symbols (upper, lower, digit, mark), the number
of runs below and above the alphabet's middle, and the serial correlation of neighbours. Its p is four times the
least of the four p-values (Bonferroni), at most 1.

Each candidate brings a decoy: as many letters of the prose before it, which goes through the same battery. In each
class of lengths, a candidate is taken if its p is at least the class's level: the lowest level at which (1 + decoys
at or above it) / (candidates at or above it) is at most the asked rate of false discoveries. Short strings, of which
prose passes some, thus need a higher level than long ones, and a class with few candidates takes none. Counts by
class and level are all that reaches the driver. Decoys are prose: identifiers that look random count as random.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.functions.model import once
from docketlake.llm.common import table, unused, written
from docketlake.llm.pii import joined, overlaps, prefixes

#: The base kinds in the order of the output: pattern, the pattern of what a text with a match holds.
BASE = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?+\x20*+[:=]\x20*+[\"']?+([A-Za-z0-9+/_.=-]++)", r"(?i:passw|secret|token|api_?key)"),
    "access": (r"AKIA[A-Z0-9]{16,}+", "AKIA[A-Z0-9]{16}"),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}+", "[0-9a-f]{24}"),
}
#: Fewest characters of an assigned value.
ASSIGNED = 6
RANDOM, LEAST = "random", 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])"
PLACE = "array<struct<start:bigint,end:bigint,text:string,before:string>>"
#: Prose is looked for in so many characters before a candidate for each of its own.
REACH = 3
#: Encodings in the order of inference: the whole string's pattern, alphabet, sizes of classes (upper, lower, digit, mark).
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = {
    "hex": ("^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", (0, 6, 10, 0)),
    "base32": ("^[A-Z2-7]+$", UPPER + "234567", (26, 0, 6, 0)),
    "base64": ("", UPPER + LOWER + DIGITS + "+/", (26, 26, 10, 2)),
}
#: Classes of lengths begin here; p is cut at these levels.
LENGTHS = (24, 32, 48, 64)
LEVELS = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3)
FALSE_RATE = 0.05


def places(text: Column, pattern: str) -> Column:
    """The pattern's matches in order: start, end (code points, exclusive), text, what stands between it and the one before."""

    def of(z: Column) -> Column:
        sizes = F.transform(z["m"], lambda m, i: (F.length(F.get(z["p"], i)) + F.length(m)).cast("bigint"))

        def place(end_of: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
            return lambda m, i: once(end_of(i) + F.length(F.get(z["p"], i)), lambda at: F.struct(at.alias("start"), (at + F.length(m)).alias("end"), m.alias("text"), F.get(z["p"], i).alias("before")))

        return once(sizes, lambda x: prefixes(x, lambda a, c: a + c, lambda end_of: F.transform(z["m"], place(end_of))))

    return once(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")), of)


def base_places(text: Column) -> dict[str, Column]:
    """The places of each base kind, failing matches dropped."""
    out = {}
    for kind, (pattern, needs) in BASE.items():
        hits = F.when(text.rlike(needs), places(text, pattern)).otherwise(F.array().cast(PLACE))
        out[kind] = F.filter(hits, lambda x: F.length(F.regexp_extract(x["text"], BASE["assign"][0], 2)) >= ASSIGNED) if kind == "assign" else hits
    return out


def upper_tail(z: Column) -> Column:
    """The chance that a normal value passes ``z``, within 0.0002."""
    return 1 / (1 + F.exp(F.least(1.5976 * z + 0.070566 * z * z * z, F.lit(700.0))))


def chi_tail(x: Column, df: int) -> Column:
    """The chance that a chi-squared value of ``df`` degrees passes ``x`` (Wilson and Hilferty's cube root)."""
    v = 2 / (9 * df)
    return upper_tail((F.cbrt(x / df) - (1 - v)) / math.sqrt(v))


def two_tails(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * upper_tail(F.abs(z)))


def without(x: Column, part: str | Column) -> Column:
    """How many characters of ``x`` stand in occurrences of ``part``."""
    return F.length(x) - F.length(F.replace(x, F.lit(part) if isinstance(part, str) else part, F.lit("")))


def tests_of(x: Column, encoding: str) -> list[Column]:
    """The battery's p-values for a string over the encoding's alphabet."""
    _, alphabet, classes = ENCODINGS[encoding]
    k, n = len(alphabet), F.length(x).cast("double")
    squares = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: without(x, F.substring(F.lit(alphabet), i, F.lit(1)))), F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    symbols = chi_tail(squares * k / n - n, k - 1)
    held = [F.length(F.regexp_replace(x, f"[^{c}]", "")) for c in ("A-Z", "a-z", "0-9", "+/")]
    terms = [(c - n * size / k) * (c - n * size / k) / (n * size / k) for c, size in zip(held, classes) if size]
    by_class = chi_tail(sum(terms[1:], terms[0]), len(terms) - 1)
    bits = F.translate(x, alphabet, "0" * (k // 2) + "1" * (k // 2))
    changes = (without(bits, "01") + without(bits, "10")) / 2
    runs = two_tails((changes - (n - 1) / 2) / (F.sqrt(n - 1) / 2))
    values = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c).cast("double") - (k + 1) / 2)
    serial = once(values, lambda v: F.aggregate(F.zip_with(v, F.slice(v, F.lit(2), F.size(v)), lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda a, c: a + c))
    return [symbols, by_class, runs, two_tails(serial / ((k * k - 1) / 12) / F.sqrt(n - 1))]


def randomness(text: Column) -> Column:
    """p of the battery for a string of base64 characters under its inferred encoding; null with fewer than two."""

    def judged(x: Column) -> Column:
        p = None
        for name, (pattern, _, _) in ENCODINGS.items():
            least = F.least(F.lit(1.0), 4 * F.least(*tests_of(F.lower(x) if name == "hex" else x, name)))
            p = F.when(x.rlike(pattern), least) if p is None else p.when(x.rlike(pattern), least) if pattern else p.otherwise(least)
        return F.when(F.length(x) >= 2, p)

    return once(F.translate(F.regexp_replace(text, "=+$", ""), "-_", "+/"), judged)


def level(p: Column) -> Column:
    """How many of ``LEVELS`` p reaches; null for null."""
    return once(p, lambda x: F.when(x.isNotNull(), sum((F.when(x >= t, 1).otherwise(0) for t in LEVELS), F.lit(0))))


def candidates(text: Column, base: Column) -> Column:
    """Per candidate: start, end, class of length, level, level of its decoy (null without enough prose), and whether
    no base span meets it (``new``)."""

    def row(x: Column) -> Column:
        n = F.length(x["text"])
        decoy = once(F.regexp_replace(F.right(x["before"], n * REACH), "[^A-Za-z]", ""), lambda prose: F.when(F.length(prose) >= n, F.right(prose, n)))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), sum((F.when(n >= c, 1).otherwise(0) for c in LENGTHS), F.lit(0)).alias("size"), level(randomness(x["text"])).alias("level"), level(randomness(decoy)).alias("decoy"), (~overlaps(x, base)).alias("new"))

    hits = F.when(text.rlike("[A-Za-z0-9+/_-]{20}"), places(text, CANDIDATE)).otherwise(F.array().cast(PLACE))
    return F.transform(F.filter(hits, lambda x: x["text"].rlike("[A-Za-z]")), row)


def levels_of(counts: list[tuple[int, int, int | None, int]], rate: float = FALSE_RATE) -> list[int]:
    """For each class of lengths the lowest level (from 1) that keeps the rate of false discoveries, or one past all.

    counts: class, level, level of the decoy or None, number. Decoys that are missing count as the others do."""
    out = []
    for size in range(len(LENGTHS) + 1):
        rows = [c for c in counts if c[0] == size]
        every, decoys = sum(c[3] for c in rows), sum(c[3] for c in rows if c[2] is not None)
        least = len(LEVELS) + 1
        for at in range(len(LEVELS), 0, -1):
            taken = sum(c[3] for c in rows if c[1] >= at)
            false = sum(c[3] for c in rows if c[2] is not None and c[2] >= at)
            if decoys and (1 + false * every / decoys) <= rate * taken:
                least = at
        out.append(least)
    return out


def secrets(docs: DataFrame, rate: float = FALSE_RATE, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_assign, n_access, n_hex, base_spans and all_spans: arrays of (kind,
    start, end) by start, then kind as listed. Columns of these five names are replaced; others stay.

    A null or empty text has no spans. Rows are searched one by one, so repeated rows repeat their spans. Levels are
    set by all rows' candidates; without enough of them only base spans are given."""
    new = {"n_assign", "n_access", "n_hex", "base_spans", "all_spans"}
    docs = docs.drop(*(c for c in docs.columns if c in new))
    kept = docs.columns if keep is None else keep
    whole, base, every = unused(docs.columns, "whole", "base", "candidates")
    kinds = [*BASE, RANDOM]

    def named(kind: str) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("start"), F.lit(kinds.index(kind)).alias("number"), F.lit(kind).alias("kind"), s["end"].alias("end"))

    held = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    held = held.withColumn(base, F.struct(*(F.transform(v, named(k)).alias(k) for k, v in base_places(F.col(whole)).items())))
    held = held.withColumn(every, candidates(F.col(whole), F.concat(*(F.col(base)[k] for k in BASE))))
    held = written(held.select(*(F.col(f"`{k}`") for k in kept), base, every), "secrets")
    counts = held.select(F.explode(every).alias("c")).groupBy("c.size", "c.level", "c.decoy").count().collect()
    least = F.array(*(F.lit(x) for x in levels_of([tuple(r) for r in counts], rate)))
    taken = F.filter(every, lambda c: c["new"] & (c["level"] >= F.get(least, c["size"])))
    spans = F.array_sort(F.concat(*(F.col(base)[k] for k in BASE)))
    every_span = F.array_sort(F.concat(*(F.col(base)[k] for k in BASE), F.transform(taken, named(RANDOM))))
    bare = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    sizes = [F.size(F.col(base)[k]).cast("bigint").alias(f"n_{k}") for k in BASE]
    return held.select(*(F.col(f"`{k}`") for k in kept), *sizes, F.transform(spans, bare).alias("base_spans"), F.transform(every_span, bare).alias("all_spans"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"))
