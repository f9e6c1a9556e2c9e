"""Line changes: scripts make the new text, paths are shortest; the daily run."""

import random

import pytest
from pyspark.sql import functions as F

from docketlake.operators import changes, daily


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def texts(seed, n=60):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a = [r.choice("abcdefgh"[: r.randrange(2, 9)]) + ("" if r.random() < 0.6 else str(r.randrange(50))) for _ in range(r.randrange(0, 40))]
        b = [x for x in a if r.random() > 0.2]
        for _ in range(r.randrange(6)):
            b.insert(r.randrange(len(b) + 1), r.choice("abcxyz"))
        out.append((a, b))
    return out


def apply(before, script):
    out, at = [], 0
    for e in script:
        if e["kind"] == "keep":
            out += before[at : at + e["n"]]
        elif e["kind"] == "add":
            out += e["lines"]
        at += 0 if e["kind"] == "add" else e["n"]
    assert at == len(before)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_scripts_make_the_new_text(seed):
    for a, b in texts(seed):
        parts = changes.edits(a, b)
        assert apply(a, changes.script_of(a, b, parts)) == b
        assert all(p[0] < q[0] or p[2] < q[2] for p, q in zip(parts, parts[1:]))


def test_paths_are_shortest(monkeypatch):
    monkeypatch.setattr(changes, "single_lines", lambda *a: [])
    longer = total = 0
    for seed in range(6):
        for a, b in texts(seed):
            kept = len(changes.common_lines([hash(x) for x in a], [hash(x) for x in b]))
            assert kept <= lcs(a, b)
            longer, total = longer + (kept < lcs(a, b)), total + 1
    assert longer <= 0.02 * total


def test_long_texts_are_quick():
    import time

    r = random.Random(1)
    a = [f"line {r.randrange(2000)}" for _ in range(20_000)]
    b = [x for x in a if r.random() > 0.05] + ["end"]
    start = time.time()
    parts = changes.edits(a, b)
    assert apply(a, changes.script_of(a, b, parts)) == b and time.time() - start < 20
    c = [f"other {i % 7}" for i in range(6000)]
    assert apply(a, changes.script_of(a, c, changes.edits(a, c))) == c


def test_unified_diff():
    import difflib

    a = [f"l{i}" for i in range(40)]
    b = [*a[:5], "new", *a[5:20], "x", *a[21:], "end"]
    want = list(difflib.unified_diff(a, b, "previous", "current", lineterm="", n=3))
    assert changes.unified(a, b, changes.edits(a, b)).split("\n") == want and changes.unified(a, a, []) == ""


def test_sections_and_patch(spark):
    rows = [("Intro\nSection 1 Scope\na\nb\nSection 2 Terms\nc", "Intro\nSection 1 Scope\na\nB\nSection 2 Terms\nc\nArticle 3\nd"), ("", "x"), (None, "Section 9"), ("same", "same"), ("a\nb", "")]
    got = spark.createDataFrame(rows, "a string, b string").withColumn("d", changes.line_changes("a", "b")).withColumn("p", changes.patched(F.coalesce("a", F.lit("")), F.col("d.script"))).collect()
    assert [r["p"] for r in got] == [b for _, b in rows]
    assert got[0]["d"]["sections"] == ["Section 1 Scope", "Article 3"] and (got[0]["d"]["added"], got[0]["d"]["removed"]) == (3, 1)
    assert got[3]["d"]["script"][0]["kind"] == "keep" and got[3]["d"]["diff"] == ""


def test_records_compare_modified_rows_alone(spark):
    s = spark.createDataFrame([("t", 1, "Section 1\na", "u"), ("t", 2, "Section 1\na", "u"), ("t", 3, "Section 1\nb", "u"), ("v", 1, None, "u")], "target string, at int, content string, url string")
    out = changes.change_records(s, "target", "at", "content", "url", F.lit('{"significance": 0.9, "impact": "high"}'))
    r = out.collect()
    assert len(r) == 1 and r[0]["diff_summary"] == "1 lines added, 1 removed in Section 1" and r[0]["affected_sections"] == ["Section 1"] and r[0]["significance_score"] == 0.9
    plan = changes.modified(s, "target", "at", "content")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Join")  # the comparison stands on top of the joins


def test_daily_run(spark):
    schema = "id string, name string, url string, last_checked timestamp, last_content_hash string, baseline_content string"
    sha = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()
    targets = spark.createDataFrame([("a", "A", "u", None, None, None), ("b", "B", "u", None, sha("x"), "x"), ("c", "C", "u", None, sha("Section 1\nx"), "Section 1\nx"), ("d", "D", "u", None, sha("x"), "x"), ("e", "E", "u", None, None, None), ("f", "F", "u", None, None, None), ("g", "G", "u", None, sha("y"), "y")], schema)
    contents = spark.createDataFrame([("a", True, "first", None), ("b", True, "x", None), ("c", True, "Section 1\nfood recall ban penalty", None), ("d", True, "z", None), ("e", False, None, "timeout"), ("f", True, "", None)], "id string, success boolean, content string, error string")
    from docketlake.functions.model import rule_scorer

    score = lambda text, d: F.when(text.contains("food"), '{"significance": 0.5, "impact": "high"}').otherwise('{"significance": 0.9, "impact": "low"}')
    rows = daily.daily_run(targets, contents, score, rule_scorer).persist()
    got = {r["id"]: r for r in rows.collect()}
    assert {i: r["change"] for i, r in got.items()} == {"a": "baseline", "b": "unchanged", "c": "modified", "d": "modified", "e": None, "f": None, "g": None}
    assert got["e"]["error"] == "Content extraction failed for E: timeout" and got["f"]["error"] == "No content extracted for F" and got["g"]["error"].startswith("Content extraction failed for G")
    assert got["c"]["alert"] and got["c"]["business_impact"] == "critical" and got["c"]["category"] == "food" and got["c"]["affected_sections"] == ["Section 1"] and not got["d"]["alert"] and got["d"]["category"] is None
    assert tuple(daily.daily_summary(rows).first()) == (7, 2, 1, 1, 3, pytest.approx(400 / 7))
    assert daily.daily_run(targets, contents, score, rule_scorer, spark.createDataFrame([("a",), ("a",), ("zz",)], "id string")).count() == 1
    after = {r["id"]: r for r in daily.checked_targets(targets, contents, rows, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert after["c"]["last_content_hash"] == sha("Section 1\nfood recall ban penalty") and after["c"]["last_checked"].year == 2024 and after["e"]["last_checked"] is None and after["g"]["baseline_content"] == "y"
    assert daily.daily_summary(rows.limit(0)).first()["success_rate"] == 0
