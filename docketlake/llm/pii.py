"""Personal data: base patterns, and further spans chosen by boosted trees. Column expressions only.

Spans come from ``split`` (the texts between the matches) and ``regexp_extract_all`` (the matches), whose running
lengths are places in code points. Patterns are possessive and start a run of characters only at its beginning, which
finds the same matches in time linear in the text.

High-recall generators propose numbers and opaque strings, which may overlap each other and base spans. Their format
and context are cut into a few bins, so that one aggregation over all candidates of the corpus gives a table of
bounded size: counts by bins and weak label. The label comes from what the trees don't see: a base span confirms the
candidate, or a name before it says that it is a secret. Trees of depth two are boosted on three quarters of the
documents (by a hash of the text) and written as CASE expressions. The other quarter calibrates: a candidate is taken
if its score is at least its kind's threshold, the lowest score above which these held-out documents have the asked
precision, and every score from there on has it among all. Texts are searched once: spans and candidates are written to the shared folder, and the table and the
result are read from there.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.functions.model import once
from docketlake.llm.common import table, unused, written

#: The base kinds in the order of the output, and their patterns.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a kind has no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Generators of further spans.
MORE = {
    "number": r"(?<![0-9A-Za-z])[0-9](?:[\x20().-]{0,2}[0-9]){6,}+(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
}
PLACE = "array<struct<start:bigint,end:bigint,text:string,left:string,right:string>>"
PRECISION, ROUNDS, RATE, RIDGE, MIN_SUPPORT = 0.95, 30, 0.3, 1.0, 5
CONTEXT = 24
BINS = {"kind": 2, "digits": 4, "letters": 3, "varied": 3, "size": 3, "groups": 3, "turns": 3, "called": 2, "quoted": 2, "joined": 2}
#: What says, before a candidate, that it is a secret: the weak label, which no bin tells.
SECRET_NAME = r"(?i)(token|secret|passw|api.?key|credential)\w*\s*[:=]?\s*[\"']?$"
CALLED = r"(?i)(phone|tel|call|fax|mobil|card|account|ssn|iban)\w*\W{0,3}$"
#: Documents of which the hash leaves 0 modulo this set the thresholds.
PARTS = 4


def running(values: Column, add: Callable[[Column, Column], Column]) -> tuple[Column, Callable[[Column], Callable[[Column], Column]]]:
    """Folds of blocks of ``values``, and from these (as a variable) what ``add``, a sum or a maximum from 0, makes of
    the first i numbers. Blocks of about the root of their number keep the work at n ** 1.5; no array grows."""
    n = F.size(values)
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))

    def fold(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("bigint"), add)

    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / size).cast("int")), lambda k: fold(F.slice(values, k * size + 1, size)))

    def first(b: Column) -> Callable[[Column], Column]:
        return lambda i: add(fold(F.slice(b, F.lit(1), F.floor(i / size).cast("int"))), fold(F.slice(values, F.floor(i / size).cast("int") * size + 1, (i % size).cast("int"))))

    return blocks, first


def prefixes(values: Column, add: Callable[[Column, Column], Column], f: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``f`` of the function that folds the first i of ``values``."""
    blocks, first = running(values, add)
    return once(blocks, lambda b: f(first(b)))


def found(text: Column, pattern: str) -> Column:
    """The pattern's matches in order: start, end (code points, exclusive), text, what stands left and right."""

    def places(z: Column) -> Column:
        sizes = F.transform(z["m"], lambda m, i: (F.length(F.get(z["p"], i)) + F.length(m)).cast("bigint"))

        def place(end_of: Callable[[Column], Column]) -> Column:
            def of(m: Column, i: Column) -> Column:
                before = F.get(z["p"], i)
                return once(end_of(i), lambda at: F.struct((at + F.length(before)).alias("start"), (at + F.length(before) + F.length(m)).alias("end"), m.alias("text"), F.right(before, F.lit(CONTEXT)).alias("left"), F.left(F.get(z["p"], i + 1), F.lit(1)).alias("right")))

            return F.transform(z["m"], of)

        return once(sizes, lambda x: prefixes(x, lambda a, c: a + c, place))

    return once(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")), places)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check of payment cards."""
    def value(i: Column) -> Column:
        d = F.substring(number, -i, F.lit(1)).cast("int") * (2 - i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def valid(kind: str, x: Column) -> Column:
    """The check that a match of the kind must pass."""
    if kind == "ip":
        small = lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255).otherwise(False)
        return F.forall(F.split(x["text"], r"\."), small)
    if kind == "card":
        n = digits(x["text"])
        return F.when(F.length(n).between(13, 19), luhn(n)).otherwise(False)
    if kind == "phone":
        return F.length(digits(x["text"])).between(9, 15)
    return F.lit(True)


def base_places(text: Column) -> dict[str, Column]:
    """The places of each base kind, failing matches dropped."""
    none = F.array().cast(PLACE)
    out = {}
    for kind, pattern in BASE.items():
        may = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9][\\x20-]?[0-9]")
        out[kind] = F.filter(F.when(may, found(text, pattern)).otherwise(none), (lambda k: lambda x: valid(k, x))(kind))
    return out


def overlaps(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"]))


def bins(kind: str, x: Column) -> dict[str, Column]:
    """Format and context of a candidate, in the bins of ``BINS``."""
    t, n = x["text"], F.length(x["text"])
    n_digits = F.length(digits(t))
    n_letters = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    n_turns = F.size(F.split(t, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])")) - 1
    return {
        "kind": F.lit(list(MORE).index(kind)),
        "digits": F.when(n_digits < 4, 0).when(n_digits < 9, 1).when(n_digits < 13, 2).otherwise(3),
        "letters": F.when(n_letters == 0, 0).when(n_letters * 2 < n, 1).otherwise(2),
        "varied": F.least(F.floor(F.size(F.array_distinct(F.split(F.left(t, F.lit(40)), ""))) / 5), F.lit(2)).cast("int"),
        "size": F.when(n < 16, 0).when(n < 32, 1).otherwise(2),
        "groups": F.least(F.size(F.split(t, "[^0-9A-Za-z]+")) - 1, F.lit(2)),
        "turns": F.when(n_turns == 0, 0).when(n_turns < 4, 1).otherwise(2),
        "called": x["left"].rlike(CALLED).cast("int"),
        "quoted": x["left"].rlike("[\"'`]$").cast("int"),
        "joined": x["left"].rlike(r"[\p{L}@/:.+]$").cast("int"),
    }


def candidates(text: Column, base: Column) -> Column:
    """Further candidates: start, end, bins, the weak label (``good``), and whether no base span meets it (``new``)."""
    lists = []
    for kind, pattern in MORE.items():
        def row(x: Column) -> Column:
            hit = overlaps(x, base)
            good = (hit | x["left"].rlike(SECRET_NAME)).cast("int")
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.struct(*(v.cast("int").alias(k) for k, v in bins(kind, x).items())).alias("bins"), good.alias("good"), (~hit).alias("new"))

        may = text.rlike("[0-9]") if kind == "number" else text.rlike("[A-Za-z0-9_-]{20}")
        lists.append(F.transform(F.when(may, found(text, pattern)).otherwise(F.array().cast(PLACE)), row))
    return F.concat(*lists)


class Trees:
    """Boosted trees of depth two over bins, with a threshold for each kind."""

    def __init__(self, table_rows: list[tuple[dict[str, int], int, int]], judged: list[tuple[dict[str, int], int, int]], precision: float = PRECISION):
        """table_rows: bins, confirmed candidates, all candidates; judged: the same of held-out documents."""
        self.trees: list[tuple[str, int, list[tuple[str, int, float, float]]]] = []
        self.prior, self.thresholds = 0.0, [math.inf] * len(MORE)
        good, every = sum(r[1] for r in table_rows), sum(r[2] for r in table_rows)
        if not every:
            return
        self.prior = math.log((good + 1) / (every - good + 1))
        score = [self.prior] * len(table_rows)
        cuts = [(name, c) for name, n in BINS.items() for c in range(1, n)]
        for _ in range(ROUNDS):
            p = [1 / (1 + math.exp(-s)) for s in score]
            g = [r[1] - r[2] * q for r, q in zip(table_rows, p)]
            h = [r[2] * q * (1 - q) for r, q in zip(table_rows, p)]

            def best(rows):
                """The cut of these rows that gains most: gain, name, cut, values on both sides."""
                out = (0.0, None, 0, 0.0, 0.0)
                for name, c in cuts:
                    side = [[0.0, 0.0], [0.0, 0.0]]
                    for i in rows:
                        s = side[table_rows[i][0][name] >= c]
                        s[0] += g[i]
                        s[1] += h[i]
                    gain = sum(a * a / (b + RIDGE) for a, b in side)
                    if gain > out[0] + 1e-9:
                        out = gain, name, c, *(RATE * a / (b + RIDGE) for a, b in side)
                return out

            _, name, c, _, _ = best(range(len(table_rows)))
            if name is None:
                break
            leaves = []
            for above in (False, True):
                rows = [i for i, r in enumerate(table_rows) if (r[0][name] >= c) == above]
                _, inner, d, low, high = best(rows)
                leaves.append((inner or name, d if inner else 0, low, high))
                for i in rows:
                    score[i] += high if table_rows[i][0][leaves[-1][0]] >= leaves[-1][1] else low
            self.trees.append((name, c, leaves))
        for kind in range(len(MORE)):
            levels: dict[float, list[int]] = {}  # score: confirmed and all, held out, then of all documents
            for rows, out in ((table_rows, False), (judged, True)):
                for b, n_good, n in rows:
                    if b["kind"] == kind:
                        level = levels.setdefault(round(self.score_of(b), 6), [0, 0, 0, 0])
                        for i, x in enumerate((n_good * out, n * out, n_good, n)):
                            level[i] += x
            good = every = 0
            for s in sorted(levels, reverse=True):
                a, b, c, d = levels[s]
                good, every = good + a, every + b
                if c < precision * d:
                    break
                if every >= MIN_SUPPORT and good >= precision * every:
                    self.thresholds[kind] = s

    def quality(self, judged: list[tuple[dict[str, int], int, int]]) -> tuple[int, int, int]:
        """Confirmed among the taken, taken, confirmed."""
        taken = [r for r in judged if round(self.score_of(r[0]), 6) >= self.thresholds[r[0]["kind"]]]
        return sum(r[1] for r in taken), sum(r[2] for r in taken), sum(r[1] for r in judged)

    def score_of(self, b: dict[str, int]) -> float:
        s = self.prior
        for name, c, leaves in self.trees:
            inner, d, low, high = leaves[b[name] >= c]
            s += high if b[inner] >= d else low
        return s

    def taken(self, b: Column) -> Column:
        """Whether a candidate with bins ``b`` is taken."""
        s = F.lit(self.prior)
        for name, c, leaves in self.trees:
            low, high = (F.when(b[inner] >= d, hi).otherwise(lo) for inner, d, lo, hi in leaves)
            s = s + F.when(b[name] >= c, high).otherwise(low)
        least = [F.lit(float(min(t, 1e9))) for t in self.thresholds]
        return F.round(s, 6) >= F.get(F.array(*least), b["kind"])


def count_table(held: DataFrame, column: str, part: str) -> tuple[list, list]:
    """Counts by bins of the candidates in ``column``: of the fitted and of the held-out documents. At most twice the
    product of ``BINS`` rows."""
    rows = held.select(F.explode(column).alias("c"), (F.col(part) == 0).alias("out")).groupBy("out", "c.bins").agg(F.sum("c.good"), F.count("*")).collect()
    names = list(BINS)
    found_rows = sorted(((r[0], r[1].asDict(), r[2], r[3]) for r in rows), key=lambda r: (r[0], [r[1][n] for n in names]))
    return [r[1:] for r in found_rows if not r[0]], [r[1:] for r in found_rows if r[0]]


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def named(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def of_kind(number: int):
    return lambda c: c["bins"]["kind"] == number


def searched(docs: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, list[str]]:
    """Columns ``keep`` of ``docs``, then places by kind, candidates and part under unused names (which are given),
    written to the shared folder."""
    whole, base, every, part = names = unused(docs.columns, "whole", "base", "candidates", "part")
    held = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    held = held.withColumn(base, F.struct(*(v.alias(k) for k, v in base_places(F.col(whole)).items())))
    found_all = candidates(F.col(whole), F.concat(*(F.col(base)[k] for k in BASE)))
    held = held.withColumn(every, found_all).withColumn(part, F.pmod(F.xxhash64(whole), F.lit(PARTS)))
    spans = F.struct(*(F.transform(F.col(base)[k], named(k)).alias(k) for k in BASE)).alias(base)
    return written(held.select(*(F.col(f"`{k}`") for k in keep), spans, every, part), "pii"), names[1:]


def personal_data(docs: DataFrame, precision: float = PRECISION, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_email, n_ip, n_card, n_phone, base_spans and all_spans: arrays of
    (kind, start, end) by kind, then start. Columns of these six names are replaced; others stay, whatever their names.

    A null or empty text has no spans. Every row is searched on its own, so repeated rows repeat their spans. The
    trees learn from all rows; without candidates, or without a precise enough kind, only base spans are given."""
    new = {"n_email", "n_ip", "n_card", "n_phone", "base_spans", "all_spans"}
    docs = docs.drop(*(c for c in docs.columns if c in new))
    kept = docs.columns if keep is None else keep
    held, (base_name, every, part) = searched(docs, kept, text)
    trees = Trees(*count_table(held, every, part), precision)
    base = F.concat(*(F.col(base_name)[k] for k in BASE))
    taken = F.filter(every, lambda c: c["new"] & trees.taken(c["bins"]))
    more = [F.transform(F.filter(taken, of_kind(i)), named(kind)) for i, kind in enumerate(MORE)]
    counts = [F.size(F.col(base_name)[k]).cast("bigint").alias(f"n_{k}") for k in BASE]
    return held.select(*(F.col(f"`{k}`") for k in kept), *counts, base.alias("base_spans"), F.concat(base, *more).alias("all_spans"))


def redact(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; spans that overlap are replaced
    together, by the kind of the first. A null text stays null; all other columns stay as they are."""
    columns = docs.columns
    spans_name, rows_name = unused(columns, "spans", "row")
    # the row goes along as one column, so that its names meet no others
    alone = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias(rows_name), F.col("text").alias("text"))
    marked = personal_data(alone, precision).select(rows_name, "text", F.array_sort(F.transform("all_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias(spans_name))
    spans = F.col(spans_name)

    def replaced(end_of: Callable[[Column], Column]) -> Column:
        """end_of: where the first i spans end, of all."""
        places = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), end_of(i).alias("after")))
        heads = F.filter(places, lambda p: p["start"] >= p["after"])
        pieces = F.transform(heads, lambda p: F.concat(F.substring("text", (p["after"] + 1).cast("int"), (p["start"] - p["after"]).cast("int")), F.lit("<"), p["kind"], F.lit(">")))
        return F.concat(F.array_join(pieces, ""), F.substring("text", (end_of(F.size(spans)) + 1).cast("int"), F.length("text")))

    ends = F.transform(spans, lambda s: s["end"])
    redacted = F.when(F.size(spans) > 0, once(ends, lambda e: prefixes(e, lambda a, c: F.greatest(a, c), replaced))).otherwise(F.col("text"))
    return marked.withColumn("text", redacted).select(*(F.col("text") if c == "text" else F.col(rows_name)[c].alias(c) for c in columns))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"))
