"""Collocations against plain counts."""

import random
import re
from collections import Counter

import brute
import numpy as np
import pytest

from docketlake.llm import phrases, queries

NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(docs, least=30, top=2000):
    """docs: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}
    gone = set()
    for (lang, w), c in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * c >= 80 * f[lang, w[i : i + k]]:
                    gone.add((lang, w[i : i + k]))
    out = {}
    for (lang, w), a in found.items():
        if (lang, w) not in gone:
            score, _, le, ri = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), le, ri))
    return [(lang, i, p.decode(), -a, le, ri, n[lang], -s) for lang in sorted(out) for i, (s, a, p, le, ri) in enumerate(sorted(out[lang])[:top], 1)]


def got(df, **options):
    out = phrases.collocations(df, **options)
    assert out.columns == NAMES
    return sorted(tuple(r) for r in out.collect())


def made(seed, n=60, words=150):
    r = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "é", "x1", "#", "É", "new", "york", "data"]
    fixed = ["new york city hall", "data of the union", "a a a a a", "the of"]
    make = lambda: " ".join(r.choice(fixed) if r.random() < 0.2 else r.choice(vocabulary) for _ in range(r.randrange(words)))
    return [(r.choice(["en", "en", "de", None, "und"]), re.sub(r" (?=a)", lambda _: r.choice([" ", "  ", "\t", ", ", "\n", "\r\n", " . "]), make())) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("most", [0, 15, 10**6])
def test_against_plain_counts(spark, seed, most, monkeypatch):
    """However many names of a level a broadcast may carry."""
    monkeypatch.setattr(phrases, "BLOCK_WORDS", [40, 100_000, 700][seed])
    monkeypatch.setattr(phrases, "BROADCAST_NAMES", most)
    docs = made(seed)
    assert got(spark.createDataFrame(docs, "lang string, text string").repartition(3), least=[5, 30, 2][seed]) == plain(docs, [5, 30, 2][seed])


def test_ranks_are_cut_and_ties_ordered(spark):
    docs = [("en", f"b{i} a{i}, c{i % 3} d{i % 3}") for i in range(40) for _ in range(3)] + [("fr", "x y")] * 3
    want = plain(docs, 2, 7)
    assert got(spark.createDataFrame(docs, "lang string, text string"), least=2, top=7) == want and len(want) == 8
    assert got(spark.createDataFrame(docs, "lang string, text string"), least=2, top=None) == plain(docs, 2, 10**9)


def test_odd_documents(spark, cluttered, empty):
    rows = [(r["lang"], r["text"]) for r in cluttered.collect()]
    assert got(cluttered, least=10) == plain(rows, 10)
    assert got(empty) == [] and got(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string"), least=1) == []


def test_large_counts_are_exact(spark):
    """Products pass 64 bits."""
    a, le, ri = 9_000_000_000_000_000_000, 9_000_000_000_000_000_001, 9_100_000_000_000_000_003
    rows = spark.createDataFrame([(1, "en", "x y", [le, a], [ri, a], a)], "id long, lang string, phrase string, heads array<bigint>, tails array<bigint>, a long")
    assert phrases.scored(rows, 2).first()["score"] == 2000000 * a // (le + ri)


def test_lowest_cut_and_its_tie(spark):
    rows = spark.createDataFrame([(1, "en", "x y z", [50, 40, 30], [60, 50, 30], 30), (2, "en", "x y z", [50, 40, 30], [50, 60, 30], 30)], "id long, lang string, phrase string, heads array<bigint>, tails array<bigint>, a long")
    assert [(r["l"], r["r"], r["score"]) for r in phrases.scored(rows, 3).orderBy("id").collect()] == [(50, 50, 600000), (50, 60, 545454)]


def test_pairs_within_a_block():
    codes, ids = np.array([0, 1, 2, -1, 0, 1, 0, 1, 3, -1], np.int32), np.array([70, 80, -1, 90])
    new, left, right, n = phrases.paired(codes, ids)
    assert sorted(zip(left.tolist(), right.tolist(), n.tolist())) == [(70, 80, 3), (80, 70, 1), (80, 90, 1)]
    runs = [x for x in "".join(chr(65 + c) if c >= 0 else " " for c in new).split()]
    assert [len(x) for x in runs] == [1, 4]


def test_query(spark, sf_dir):
    docs = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = plain(docs)
    assert sorted(tuple(r) for r in queries.QUERIES["op12_phrases"](spark, sf_dir).collect()) == want and want


def test_sql(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    out = con.execute(queries.ORACLE_SQL["op12_phrases"])
    names = [d[0] for d in out.description]
    rows = sorted(tuple(dict(zip(names, r))[n] for n in NAMES) for r in out.fetchall())
    assert rows == plain(con.execute("SELECT lang, text FROM documents").fetchall())


def test_names_are_places_in_order(spark):
    """A broadcast of names is their sorted keys, 8 bytes each; what workers are handed at a time is as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    level = phrases.Level(phrases.blocks(spark.createDataFrame(made(5), "lang string, text string").repartition(3)))
    words = level.named(2)
    level = level.next(words)
    pairs = level.named(2)
    known = level.next(pairs).chain[-1].value
    rows = pairs.orderBy("left", "right").toArrow()
    assert [r["id"] for r in words.orderBy("lang", "words").collect()] == list(range(words.count()))
    assert rows["id"].to_pylist() == list(range(pairs.count())) and len(rows) > 50
    assert sum(x.nbytes for x in vars(known).values() if isinstance(x, np.ndarray)) == 8 * len(rows)
    assert known.ids(rows["left"].to_numpy(), rows["right"].to_numpy()).tolist() == rows["id"].to_pylist()
    assert known.ids(np.array([0]), np.array([10**6])).tolist() == [-1] and spark.conf.get(key) == before


def test_blocks_lie_in_memory_a_few_at_a_time(spark, monkeypatch):
    """Files of blocks are read as workers are handed them (once 4,096 rows of 2 to 3 MB at a time), in pages of as few
    rows; sums are written in order at once, not first in a file for each task of theirs."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    seen, before = [], spark.conf.get(key)

    def noted(df, name, *rows):
        seen.append((df.columns[0], spark.conf.get(key), *rows))
        return written(df, name, *rows)

    written = phrases.written
    monkeypatch.setattr(phrases, "written", noted)
    held = phrases.blocks(spark.createDataFrame([("en", "a b a b a")], "lang string, text string"))
    names = phrases.Level(held).named(1)
    assert seen == [("lang", str(min(1000, int(before))), phrases.HANDED_BLOCKS), ("lang", str(phrases.HANDED_BLOCKS))]
    assert spark.conf.get(key) == before and sorted((r["words"], r["f"], r["id"]) for r in names.collect()) == [("a", 3, 0), ("b", 2, 1)]
