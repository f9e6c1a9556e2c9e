"""Change detection between snapshots by hash; what changed as an edit script by lines, aligned to the sections.

Hashes alone go through the window; texts are joined to what changed. Lines are compared as numbers. Equal beginnings
and ends go first; then lines that both texts hold once, in an order that both share, part the rest; what is left between
two of these is compared by the shortest edit path, searched from both ends at once, so that memory is linear. Where such a
search takes more than ``MOST_STEPS`` steps, all lines between count as replaced: longer than need be, but right."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.dictionaries import SECTION_MARKERS
from docketlake.shipping import ship_package

CHANGE = "struct<script:array<struct<kind:string,n:int,lines:array<string>>>,added:int,removed:int,sections:array<string>,diff:string>"
MOST_STEPS, CONTEXT = 2000, 3
Block = tuple[int, int, int, int]  # lines of the old text from, to; of the new text from, to


def change_status(snapshots: DataFrame, target: str, order: str, content: str) -> DataFrame:
    """Each snapshot's hash against the one before it of its target: baseline, unchanged or modified."""
    before = Window.partitionBy(target).orderBy(order)
    hashed = snapshots.withColumn("content_hash", F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256))
    prev = F.lag("content_hash").over(before)
    return hashed.withColumn("change", F.when(prev.isNull(), "baseline").when(prev == F.col("content_hash"), "unchanged").otherwise("modified"))


def common_lines(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of lines that stay, in order."""
    out: list[tuple[int, int]] = []
    todo: list[Block] = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        marks = single_lines(a, b, (a0, a1, b0, b1)) or middle(a, b, (a0, a1, b0, b1))
        for (x0, y0), (x1, y1) in zip([(a0, b0), *marks], [*marks, (a1, b1)]) if marks else ():
            todo.append((x0, x1, y0, y1))
    return sorted(out)


def single_lines(a: list[int], b: list[int], block: Block) -> list[tuple[int, int]]:
    """Places of lines that stand once in both parts, the most that are in the same order in both."""
    a0, a1, b0, b1 = block
    once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    at = {x: j for j, x in enumerate(b[b0:b1], b0) if once_b[x] == 1}
    pairs = [(i, at[x]) for i, x in enumerate(a[a0:a1], a0) if once_a[x] == 1 and x in at]
    ends: list[int] = []  # least last place in the new text of a run of each length
    held: list[int] = []
    up = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(ends, j)
        up[k] = held[n - 1] if n else -1
        ends[n : n + 1], held[n : n + 1] = [j], [k]
    out, k = [], held[-1] if held else -1
    while k >= 0:
        out.append(pairs[k])
        k = up[k]
    return out[::-1]


def middle(a: list[int], b: list[int], block: Block) -> list[tuple[int, int]]:
    """A point on a shortest edit path where the searches from both ends meet; none if that takes too many steps."""
    a0, a1, b0, b1 = block
    n, m = a1 - a0, b1 - b0
    ahead, back, delta = {1: 0}, {1: 0}, n - m
    for d in range(min((n + m + 1) // 2, MOST_STEPS) + 1):
        for k in range(-d, d + 1, 2):
            x = ahead.get(k + 1, -1) if k == -d or k != d and ahead.get(k - 1, -1) < ahead.get(k + 1, -1) else ahead.get(k - 1, -1) + 1
            y = x - k
            while 0 <= x < n and 0 <= y < m and a[a0 + x] == b[b0 + y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            if delta % 2 and abs(delta - k) < d and x + back.get(delta - k, -1) >= n and 0 <= x <= n and 0 <= y <= m:
                return _inside(a0 + x, b0 + y, block)
        for k in range(-d, d + 1, 2):
            x = back.get(k + 1, -1) if k == -d or k != d and back.get(k - 1, -1) < back.get(k + 1, -1) else back.get(k - 1, -1) + 1
            y = x - k
            while 0 <= x < n and 0 <= y < m and a[a1 - 1 - x] == b[b1 - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if not delta % 2 and abs(delta - k) <= d and x + ahead.get(delta - k, -1) >= n and 0 <= x <= n and 0 <= y <= m:
                return _inside(a1 - x, b1 - y, block)
    return []


def _inside(x: int, y: int, block: Block) -> list[tuple[int, int]]:
    a0, a1, b0, b1 = block
    return [] if (x, y) in ((a0, b0), (a1, b1)) else [(x, y)]


def edits(before: list[str], after: list[str]) -> list[Block]:
    """Parts that were replaced (one side may be empty), in order."""
    numbers: dict[str, int] = {}
    a, b = ([numbers.setdefault(x, len(numbers)) for x in lines] for lines in (before, after))
    out, i, j = [], 0, 0
    for x, y in [*common_lines(a, b), (len(a), len(b))]:
        if x > i or y > j:
            out.append((i, x, j, y))
        i, j = x + 1, y + 1
    return out


def script_of(before: list[str], after: list[str], parts: list[Block]) -> list[dict]:
    """keep n, drop n and add lines, which make the new text of the old."""
    out, at = [], 0
    for a0, a1, b0, b1 in [*parts, (len(before), len(before), 0, 0)]:
        out += [{"kind": "keep", "n": a0 - at, "lines": None}] * (a0 > at) + [{"kind": "drop", "n": a1 - a0, "lines": None}] * (a1 > a0) + [{"kind": "add", "n": b1 - b0, "lines": after[b0:b1]}] * (b1 > b0)
        at = a1
    return out


def section_titles(lines: list[str], markers=SECTION_MARKERS) -> list[str]:
    """The section that each line stands in: the last line with a marker; before the first, none."""
    out, title = [], ""
    for x in lines:
        low = x.lower()
        title = x.strip() if any(m in low for m in markers) else title
        out.append(title)
    return out


def unified(before: list[str], after: list[str], parts: list[Block], context: int = CONTEXT) -> str:
    """The parts with lines of context, near ones together."""
    groups: list[list[Block]] = []
    for p in parts:
        if groups and p[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(p)
        else:
            groups.append([p])
    out = ["--- previous", "+++ current"] if parts else []
    for g in groups:
        a0, b0 = max(0, g[0][0] - context), max(0, g[0][2] - min(context, g[0][0]))
        a1, b1 = min(len(before), g[-1][1] + context), min(len(after), g[-1][3] + context)
        out.append(f"@@ -{a0 + (a1 > a0)},{a1 - a0} +{b0 + (b1 > b0)},{b1 - b0} @@")
        at = a0
        for p in g:
            out += [f" {x}" for x in before[at : p[0]]] + [f"-{x}" for x in before[p[0] : p[1]]] + [f"+{x}" for x in after[p[2] : p[3]]]
            at = p[1]
        out += [f" {x}" for x in before[at:a1]]
    return "\n".join(out)


def compared(before: str | None, after: str | None) -> dict:
    a, b = (before or "").split("\n"), (after or "").split("\n")
    parts = edits(a, b)
    old, new = section_titles(a), section_titles(b)
    touched = [t for p in parts for t in [*old[p[0] : p[1]], *new[p[2] : p[3]]] if t]
    return {"script": script_of(a, b, parts), "added": sum(p[3] - p[2] for p in parts), "removed": sum(p[1] - p[0] for p in parts), "sections": list(dict.fromkeys(touched)), "diff": unified(a, b, parts)}


def line_changes(before: str | Column, after: str | Column) -> Column:
    """Script, lines added and removed, titles of the sections concerned, unified diff."""

    @F.pandas_udf(CHANGE)
    def run(old: pd.Series, new: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compared(a, b) for a, b in zip(old, new)], columns=["script", "added", "removed", "sections", "diff"])

    return run(before, after)


def patched(before: Column, script: Column) -> Column:
    """The new text that a script makes of the old."""
    lines = F.split(before, "\n", -1)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        more = F.when(e["kind"] == "keep", F.slice(lines, s["at"], e["n"])).when(e["kind"] == "add", e["lines"]).otherwise(F.array().cast("array<string>"))
        return F.struct((s["at"] + F.when(e["kind"] == "add", 0).otherwise(e["n"])).alias("at"), F.concat(s["out"], more).alias("out"))

    return F.aggregate(script, start, step, lambda s: F.array_join(s["out"], "\n"))


def modified(snapshots: DataFrame, target: str, order: str, content: str) -> DataFrame:
    """The modified snapshots with ``before`` (the text of the one before) and ``change_details``. (target, order) tells
    snapshots apart; only these rows' texts are compared."""
    before = F.lag(order).over(Window.partitionBy(target).orderBy(order))
    status = change_status(snapshots.select(target, order, content), target, order, content).withColumn("_from", before)
    changed = status.where("change = 'modified'").drop(content)
    texts = snapshots.select(F.col(target).alias("_target"), F.col(order).alias("_order"), F.col(content).alias("before"))
    ship_package(snapshots.sparkSession)
    joined = changed.join(snapshots, [target, order]).join(texts, (F.col(target) == F.col("_target")) & (F.col("_from") == F.col("_order")))
    return joined.withColumn("change_details", line_changes("before", content)).drop("_from", "_target", "_order")


def changes(snapshots: DataFrame, target: str, order: str, content: str, preview: int = 1000) -> DataFrame:
    """The modified snapshots with the head of their diff."""
    return modified(snapshots, target, order, content).withColumn("diff", F.left("change_details.diff", F.lit(preview))).drop("before", "change_details")


def summary(details: Column) -> Column:
    """A change in words: lines added and removed, and the sections concerned."""
    where = F.when(F.size(details["sections"]) > 0, F.concat(F.lit(" in "), F.array_join(details["sections"], "; "))).otherwise("")
    return F.concat(details["added"].cast("string"), F.lit(" lines added, "), details["removed"].cast("string"), F.lit(" removed"), where)


def change_records(snapshots: DataFrame, target: str, order: str, content: str, url: str, replies: Column) -> DataFrame:
    """Records of the changes: document_id, url, change_type, hashes, diff_summary, affected_sections, significance_score
    and compliance_impact by ``replies``, a scorer's replies over the columns before, the content and change_details."""
    rows = modified(snapshots, target, order, content)
    s = significance(replies)
    return rows.select(
        F.col(target).cast("string").alias("document_id"), F.col(url).alias("url"), F.lit("modified").alias("change_type"), F.col(order).alias("change_date"), F.sha2(F.coalesce("before", F.lit("")).cast("binary"), 256).alias("previous_content_hash"),
        F.col("content_hash").alias("current_content_hash"), summary(F.col("change_details")).alias("diff_summary"), F.col("change_details.sections").alias("affected_sections"), s["significance"].alias("significance_score"), s["impact"].alias("compliance_impact"))


def significance(reply: Column) -> Column:
    """A scorer's JSON reply with the values that stand in for what it lacks: .5 and medium; without reply .5 and unknown."""
    r = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "struct<significance:double,impact:string>")
    return F.struct(F.coalesce(r["significance"], F.lit(0.5)).alias("significance"), F.when(reply.isNull(), "unknown").otherwise(F.coalesce(r["impact"], F.lit("medium"))).alias("impact"))


def with_names(changes_df: DataFrame, targets: DataFrame) -> DataFrame:
    """Names of the targets; the id where there is none."""
    return changes_df.join(targets.select("target_id", "name"), "target_id", "left").withColumn("name", F.coalesce("name", F.col("target_id").cast("string")))
