"""Conversation prefix trie, built as a Patricia tree over sorted conversations.

A conversation's path is the chain of its turns' digests, 24 characters each. Equal conversations become one sequence
with their number, least id and digest of ids; the ids go in sorted runs of bounded length through one running hash.
Sequences are sorted by path and dealt in ranges. Each task walks its range with a stack that holds branch, end and
leaf points alone, with compressed edges between them: the common prefix of two neighbours tells where to branch.

A node is a range of neighbours, so members, leaves and words are sums over sequences: with m copies of T words, of
which x stand beyond the prefix shared with the neighbour before, a node of n members whose path above holds C words
saves sum(m * T) - n * C - sum(x) (less what the first member shares out above the node). Nodes along an edge have
what the point below has, and save (n - 1) times the words of the edge between, a suffix sum, on top.

The paths on which a range meets its neighbours aren't compressed: each depth of them is a piece, whose sums are added
over ranges by the prefix's digest. All else is complete within its task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketlake.llm.common import map_batches, table, written

#: Characters of a turn's digest; conversations that share a home, and most of its turns that they take.
TOKEN, HOME, HEAD = 24, 20, 4
#: Ids in a run; turns of distinct conversations in a range.
RUN, RANGE_TURNS = 1000, 300_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
SEQUENCE = "path string, words array<bigint>, n bigint, conv_id bigint, ends string"
NODE = "part int, kind int, key string, parent_key string, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string"
#: Kinds of rows that a range gives: complete, complete but for its parent's id, a piece.
DONE, BELOW_PIECE, PIECE = 0, 1, 2


def short_digest(x):
    return F.substring(F.base64(F.unhex(F.sha2(x, 256))), 1, TOKEN)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path and words by turn of every rebuilt conversation, and the path's digest ``key``."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    turns = conversations.where(conv.isNotNull()).select(
        (conv - conv % HOME).alias("home"), conv.alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").cast("long").alias("turn"), short_digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")).alias("t"),
    )
    each = turns.repartition("home").groupBy("home", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    homes = each.groupBy("home").agg(F.collect_list(F.struct("conv_id", "turns")).alias("all"))  # at most 2 * HOME - 1
    first = F.get(F.filter("all", lambda c: c["conv_id"] == F.col("home")), 0)["turns"]
    split = homes.select(F.slice(F.coalesce(first, F.array().cast("array<struct<known:boolean,turn:bigint,digest:string,words:bigint>>")), 1, HEAD - 1).alias("head"), F.explode("all").alias("c"))
    taken = (F.crc32(F.col("c.conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    whole = split.select(F.col("c.conv_id").alias("conv_id"), F.concat(F.slice("head", F.lit(1), taken), F.slice("c.turns", taken + 1, F.size("c.turns"))).alias("t"))
    return whole.select("conv_id", F.array_join(F.transform("t", lambda t: t["digest"]), "").alias("path"), F.transform("t", lambda t: t["words"]).alias("words")).withColumn("key", short_digest(F.col("path")))


def rows_of(batches) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def packed(rows, names: list[str], types: list[pa.DataType], size: int = 5000) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches."""
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def sequences(conversations: DataFrame) -> DataFrame:
    """Distinct paths with words by turn, number of conversations, least conv_id and digest of all ids."""
    longs = pa.list_(pa.int64())

    def runs(batches):
        """Sorted rows: per key, ids in runs."""

        def each():
            for _, same in groupby(rows_of(batches), lambda r: r["key"]):
                held = []
                for r in same:
                    held.append(r["conv_id"])
                    if len(held) == RUN:
                        yield r["key"], held[0], len(held), ",".join(map(str, held)), r["path"], r["words"]
                        held = []
                if held:
                    yield r["key"], held[0], len(held), ",".join(map(str, held)), r["path"], r["words"]

        yield from packed(each(), ["key", "first", "n", "ids", "path", "words"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), longs])

    def whole(batches):
        """Sorted runs: per key one sequence; one run is held at a time."""

        def each():
            for _, same in groupby(rows_of(batches), lambda r: r["key"]):
                n, digest, first = 0, hashlib.sha256(), None
                for r in same:
                    if n:
                        digest.update(b",")
                    digest.update(r["ids"].encode())
                    n, first = n + r["n"], r if first is None else first
                yield first["path"], first["words"], n, first["first"], digest.hexdigest()

        yield from packed(each(), ["path", "words", "n", "conv_id", "ends"], [pa.string(), longs, pa.int64(), pa.int64(), pa.string()])

    rows = rebuilt(conversations).repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = map_batches(rows, runs, "key string, first bigint, n bigint, ids string, path string, words array<bigint>")
    return map_batches(chunks.repartition("key").sortWithinPartitions("key", "first"), whole, SEQUENCE)


def shared(a: str, b: str) -> int:
    """Turns in which two paths begin alike."""
    k, most = 0, min(len(a), len(b)) // TOKEN
    while k < most and a[TOKEN * k : TOKEN * k + TOKEN] == b[TOKEN * k : TOKEN * k + TOKEN]:
        k += 1
    return k


class Point:
    """A branch, end or leaf, with sums over the sequences below. Nodes on its path below depth ``fresh`` are new here."""

    __slots__ = ("depth", "path", "pre", "fresh", "n", "leaves", "total", "new", "conv_id", "children", "ends", "piece", "above")

    def __init__(self, depth: int, path: str, pre: list[int], fresh: int, piece: bool = False):
        self.depth, self.path, self.pre, self.fresh, self.piece = depth, path, pre, fresh, piece
        self.n = self.leaves = self.total = self.new = self.children = 0
        self.conv_id = self.ends = self.above = None

    def words_above(self, depth: int) -> int:
        return self.pre[depth - 1] if depth else 0

    def saved(self) -> int:
        """Saved tokens of the subtree as far as this range holds it."""
        above = self.words_above(self.depth)
        new = self.new - (above - self.pre[max(self.fresh, 0)] if self.depth > self.fresh else 0)
        return self.total - self.n * above - new

    def take(self, child: Point) -> None:
        child.above = self
        self.n, self.leaves, self.total, self.new = self.n + child.n, self.leaves + child.leaves, self.total + child.total, self.new + child.new
        self.conv_id = child.conv_id if self.conv_id is None else min(self.conv_id, child.conv_id)
        self.children += self.depth + 1 > child.fresh

    def key(self, depth: int) -> str:
        return hashlib.sha256(self.path[: TOKEN * depth].encode()).hexdigest()[:32]


def points(rows: list[dict]) -> list[Point]:
    """The points of a sorted range; rows that are marked are the neighbours' nearest sequences."""
    own = [r for r in rows if not r["mark"]]
    before = next((r["path"] for r in rows if r["mark"] == -1), None)
    after = next((r["path"] for r in rows if r["mark"] == 1), None)
    out: list[Point] = []
    stack: list[Point] = []

    def close(least: int) -> None:
        """Take off the points deeper than ``least``, where a point is left."""
        while stack[-1].depth > least:
            child = stack.pop()
            if stack[-1].depth < least:
                stack.append(Point(least, child.path, child.pre, child.fresh))
            if not child.children and child.ends:
                child.leaves = 1
            stack[-1].take(child)
            out.append(child)

    last = None
    for r in own:
        pre = list(accumulate(r["words"], initial=0))
        at = shared(last, r["path"]) if last is not None else -1 if before is None else shared(before, r["path"])
        if last is None:
            stack += [Point(d, r["path"], pre, at, True) for d in range(max(at, 0) + 1)]
        else:
            close(at)
        length = len(r["words"])
        if stack[-1].depth < length:
            stack.append(Point(length, r["path"], pre, at))
        p = stack[-1]
        p.n, p.total, p.new, p.conv_id, p.ends = r["n"], r["n"] * pre[-1], pre[-1] - pre[max(at, 0)], r["conv_id"], r["ends"]
        last = r["path"]
    if last is None:
        return out
    right = 0 if after is None else shared(last, after)
    close(right)
    while stack:  # the path shared with the next range, depth by depth
        child = stack.pop()
        child.piece = True
        out.append(child)
        if child.depth:
            if stack[-1].depth < child.depth - 1:
                stack.append(Point(child.depth - 1, child.path, child.pre, child.fresh))
            stack[-1].take(child)
    if after is None and out[-1].ends and not out[-1].children:
        out[-1].leaves = 1  # the root alone
    return out


def nodes(rows: list[dict], part: int) -> Iterator[tuple]:
    """The range's nodes: its points, and the nodes along their edges."""
    for p in points(rows):
        saved = p.saved()
        if p.piece:
            yield part, PIECE, p.key(p.depth), p.key(p.depth - 1) if p.depth else None, p.conv_id, p.depth, None, p.n, p.children, p.leaves, saved, p.ends
            continue
        up = p.above
        for d in range(p.depth, up.depth, -1):
            edge = (p.n - 1) * (p.words_above(p.depth) - p.words_above(d))
            children, ends = (p.children, p.ends) if d == p.depth else (1, None)
            top = d == up.depth + 1
            known = up.conv_id if top else p.conv_id
            piece = top and up.piece
            yield part, BELOW_PIECE if piece else DONE, None, up.key(up.depth) if piece else None, p.conv_id, d, None if piece else known, p.n, children, p.leaves, saved + edge, ends


def prefix_trie(conversations: DataFrame, range_turns: int = RANGE_TURNS) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Rows of a null conv_id belong to no conversation. Null turns come first; turns that tie are ordered by the digest
    of role and text, so repeated rows stand side by side. Null and empty roles and texts are the same. No
    conversations: no nodes. Other columns are not read. A conversation is one row of 32 bytes a turn, texts aside."""
    held = written(sequences(conversations), "conversations")
    size = held.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    dealt = written(held.repartitionByRange(-(-size // range_turns) or 1, "path").withColumn("part", F.spark_partition_id()), "conversations")
    bounds = dealt.groupBy("part").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    order = Window.orderBy("part")  # a row for each range
    bounds = bounds.select("part", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    marks = bounds.select("part", F.explode(F.array(F.struct(F.lit(-1).alias("mark"), F.col("before").alias("path")), F.struct(F.lit(1).alias("mark"), F.col("after").alias("path")))).alias("m")).select("part", "m.mark", "m.path").where("path IS NOT NULL")
    every = dealt.withColumn("mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)

    def walk(batches):
        def each():
            for part, rows in groupby(rows_of(batches), lambda r: r["part"]):
                yield from nodes(list(rows), part)

        types = [pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 7, pa.string()]
        yield from packed(each(), [x.split()[0] for x in NODE.split(", ")], types)

    rows = written(map_batches(every.repartition("part").sortWithinPartitions("part", "path"), walk, NODE), "conversations")
    pieces = rows.where(F.col("kind") == PIECE)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = pieces.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_key").alias("parent_key"), *sums, F.max("ends").alias("ends"))
    ids = merged.select(F.col("key").alias("up"), F.col("conv_id").alias("up_conv_id"))
    tops = merged.join(ids, F.col("parent_key") == F.col("up"), "left").withColumn("parent_conv_id", F.col("up_conv_id"))
    by_range = pieces.select("part", "key").join(ids, F.col("key") == F.col("up")).select(F.col("part").alias("of"), "up", "up_conv_id")
    below = rows.where(F.col("kind") == BELOW_PIECE).join(by_range, (F.col("part") == F.col("of")) & (F.col("parent_key") == F.col("up"))).withColumn("parent_conv_id", F.col("up_conv_id"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    out = rows.where(F.col("kind") == DONE).select(*names).unionByName(below.select(*names)).unionByName(tops.select(*names))
    return out.select(*names[:-1], F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
