"""The prefix trie against a plain one."""

import random
import zlib

import brute
import pytest

from docketlake.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(rows):
    """rows: (conv_id, turn, role, text), turns of a conversation that tie in no need of an order."""
    own = {}
    for c, t, r, x in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[1] is not None, x[1] or 0)):
        own.setdefault(c, []).append((r or "", x or ""))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        home = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(own.get(home, [])[:h] + turns[h:])
    members, ends = {}, {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
        ends.setdefault(turns, []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[b] for b in below) or 1
        saved[p] = (len(members[p]) - 1) * len(brute.words(p[-1][1]) if p else []) + sum(saved[b] for b in below)
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves[p], saved[p], brute.sha(",".join(map(str, sorted(ends.get(p, [])))))))
    return sorted(out, key=str)


def got(df, **options):
    out = conversations.prefix_trie(df, **options)
    assert out.columns == NAMES
    return sorted((tuple(r) for r in out.collect()), key=str)


def made(seed, n=120, texts=3, length=6):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        c = r.randrange(-90, 400)
        for t in range(r.randrange(1, length)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["", None, "a b", "a  b c", "d", "long text of several words"][: texts + 1])))
    seen = {}
    return [x for x in rows if seen.setdefault(x[:2], x) is x]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("range_turns", [10, 100_000])
def test_against_plain_trie(spark, seed, range_turns, monkeypatch):
    monkeypatch.setattr(conversations, "RUN", 3)
    rows = made(seed, texts=1 + 2 * (seed == 1), length=[4, 6, 40][seed])
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(4), range_turns=range_turns) == trie(rows)


def test_any_cut_into_ranges():
    """Pieces of ranges of one, two or more sequences add up to the whole tree."""
    r = random.Random(3)
    for _ in range(60):
        paths = sorted({"".join(r.choice("AB") * conversations.TOKEN for _ in range(r.randrange(0, 7))) for _ in range(r.randrange(1, 14))})
        weight = {"A": 2, "B": 5}
        rows = [{"path": p, "words": [weight[x] for x in p[:: conversations.TOKEN]], "n": r.randrange(1, 4), "conv_id": i, "ends": f"e{i}", "mark": 0} for i, p in enumerate(r.sample(paths, len(paths)))]
        rows.sort(key=lambda x: x["path"])

        def pieces(size):
            done, parts, below = [], {}, []
            for k in range(0, len(rows), size):
                mine = rows[k : k + size]
                marks = ([{"path": rows[k - 1]["path"], "mark": -1}] if k else []) + ([{"path": rows[k + size]["path"], "mark": 1}] if k + size < len(rows) else [])
                for _, kind, key, up, *x in conversations.nodes(mine + marks, k):
                    if kind == conversations.PIECE:
                        p = parts.setdefault(key, [up, x[0], x[1], 0, 0, 0, 0, None])
                        p[1] = min(p[1], x[0])
                        for i in range(4):
                            p[3 + i] += x[3 + i]
                        p[7] = p[7] or x[7]
                    elif kind == conversations.BELOW_PIECE:
                        below.append((x, up))
                    else:
                        done.append(tuple(x))
            done += [(x[0], x[1], parts[up][1], *x[3:]) for x, up in below]
            done += [(p[1], p[2], parts[p[0]][1] if p[0] else None, *p[3:]) for p in parts.values()]
            return sorted(done, key=str)

        whole = pieces(len(rows))
        assert all(pieces(size) == whole for size in (1, 2, 3, 5))


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (7, None, None, None), (7, 3, "user", "b"), (7, -1, "user", "é ü"), (41, 0, "user", "only"), (44, 0, "u", "a"), (60, 0, "u", "w " * 4000), (60, 1, "u", "q"), (-3, 5, "u", "n")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == trie(rows)
    clutter = df.selectExpr("*", "1 AS home", "2 AS path", "3 AS words", "'x' AS key", "4 AS t", "5 AS part", "6 AS mark", "7 AS ends", "8 AS n")
    assert got(clutter) == trie(rows)
    assert got(df.limit(0)) == [] and got(df.where("conv_id IS NULL")) == []
    turnless = [(1, 0, "u", "a")]  # without its home, 1 loses its first turns
    assert got(spark.createDataFrame(turnless, SCHEMA)) == trie(turnless)


def test_ties_and_repeats_have_one_order(spark):
    rows = [(4, 1, "u", x) for x in "abca"] + [(24, 1, "u", x) for x in "caab"]
    first = got(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert first == got(spark.createDataFrame(rows[::-1], SCHEMA).coalesce(1)) and sum(x[1] == 4 for x in first) >= 1


def test_copies_and_a_hot_first_turn(spark, monkeypatch):
    monkeypatch.setattr(conversations, "RUN", 7)
    rows = [(i * 20, t, "u", f"copy {t}") for i in range(60) for t in range(3)] + [(2000 + i * 20, t, "u", "hello" if t == 0 else f"{i} {t}") for i in range(80) for t in range(4)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5), range_turns=25) == trie(rows)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.QUERIES["op11_conversations"](spark, sf_dir).collect()), key=str) == trie(rows)


def test_sql(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    out = con.execute(queries.ORACLE_SQL["op11_conversations"])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(NAMES)
    rows = [tuple(r) for r in con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()]
    assert sorted((tuple(dict(zip(names, r))[n] for n in NAMES) for r in con.execute(queries.ORACLE_SQL["op11_conversations"]).fetchall()), key=str) == trie(rows)
