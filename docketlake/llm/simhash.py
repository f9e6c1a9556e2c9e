"""SimHash near-duplicates: fingerprints, and a binary-trie self-join under a Hamming budget.

Equal fingerprints are one node. A pair within the budget agrees on some blocks of its bits, so nodes are dealt by
(which blocks, their bits); alone in their deal they have no partner there. A deal of more than ``DEAL`` nodes is dealt
again, by further blocks of the bits that it doesn't fix, of which the pair agrees on one too. What meets is joined by walking a binary
trie against itself, all node pairs of one depth together: a pair of subtrees whose differing bits exceed the
budget is pruned. Each deal emits a forest (at most one link per node), not its pairs, which keeps components
exactly. Components over the whole table come from rounds of large-star and small-star over these links, written to
the checkpoint folder after each round.

Sets of shingles that are less alike (``keep_one_similar``) differ in too many bits for that: they have several
fingerprints, meet in deals by some of their bits, and are held to a Hamming budget before they are compared exactly.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.llm.common import map_batches, shared_folder, table, texts, unused

BITS = 64
#: A deal should hold few unrelated nodes: blocks are added until this many would meet by chance.
CHANCE = 8
#: Nodes that a deal holds at most, if its bits can tell them apart, and that a task gets on average.
DEAL, TASK_NODES = 50_000, 20_000
#: How often a large deal is dealt again; nodes that agree on most bits stay together then, 8 bytes each.
LEVELS = 2


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included, as big-endian numbers; a text of fewer words is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, ">u8")
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    starts = np.r_[0, ends[:-1]][:n].tolist()
    stops = (ends[-n:] - 1).tolist() if n > 1 or len(words) >= shingle else [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, stops)), ">u8", n)


def fingerprint(text: bytes, shingle: int) -> int:
    """64-bit SimHash over the shingle hashes, repeats included; no words: zero."""
    hashes = shingle_hashes(text, shingle)
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 4096):  # bounded memory for long texts
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``docs`` with ``_fp``, the fingerprint as a signed long. Null and empty texts have zero."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "_fp long"])

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in texts(b)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], names=[*b.schema.names, "_fp"])

    return map_batches(docs, run, schema)


def block_masks(budget: int, n_nodes: int) -> list[int]:
    """Masks such that fingerprints within the budget agree on all bits of at least one of them."""
    for shared in (1, 2, 3):
        n = budget + shared
        edges = [BITS * i // n for i in range(n + 1)]
        blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
        masks = [sum(x) for x in combinations(blocks, shared)]
        if n_nodes <= CHANCE << min(m.bit_count() for m in masks) or shared == 3:
            return masks


def trie_pairs(fps: np.ndarray, budget: int):
    """Pairs (i, j), i < j, of sorted distinct fingerprints that differ in 1 to ``budget`` bits, in blocks.

    The trie over sorted numbers is implicit: a node is a range that shares its first bits. Node pairs are walked
    depth first in blocks, so that what is in work stays bounded."""
    one = np.uint64(1)
    # a pair of nodes: [a0, a1) and [b0, b1), bits differing so far; a node with itself starts the walk
    stack = [(np.array([0]), np.array([len(fps)]), np.array([0]), np.array([len(fps)]), np.array([0]), 0)]
    while stack:
        a0, a1, b0, b1, far, depth = stack.pop()
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any() or depth == BITS:
            x, y = a0[single], b0[single]
            if len(x):
                near = np.bitwise_count(fps[x] ^ fps[y]) <= budget
                near &= x != y
                if near.any():
                    yield x[near], y[near]
            rest = ~single
            a0, a1, b0, b1, far = a0[rest], a1[rest], b0[rest], b1[rest], far[rest]
        if not len(a0) or depth == BITS:
            continue
        if len(a0) > 1 << 17:
            half = len(a0) // 2
            for part in (slice(half, None), slice(half)):
                stack.append((a0[part], a1[part], b0[part], b1[part], far[part], depth))
            continue
        bit = np.uint64(BITS - 1 - depth)

        def middle(lo, hi):
            # where the node's second child begins: the first number with the bit set
            base = (fps[lo] >> bit | one) << bit
            return np.clip(np.searchsorted(fps, base), lo, hi)

        am, bm = middle(a0, a1), middle(b0, b1)
        same = (a0 == b0) & (a1 == b1)
        out = []
        for p0, p1, q0, q1, add, wanted in (
            (a0, am, b0, bm, 0, None),
            (am, a1, bm, b1, 0, None),
            (a0, am, bm, b1, 1, None),
            (am, a1, b0, bm, 1, ~same),  # of a node with itself, mixed children count once
        ):
            ok = (p1 > p0) & (q1 > q0) & (far + add <= budget)
            if wanted is not None:
                ok &= wanted
            ok &= ~((p0 == q0) & (p1 == q1) & (p1 - p0 == 1))
            out.append((p0[ok], p1[ok], q0[ok], q1[ok], far[ok] + add))
        stack.append((*(np.concatenate([o[i] for o in out]) for i in range(5)), depth + 1))


def merged(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``root``, the smallest member of each node's component, after the links (x, y)."""
    while True:
        x, y = root[x], root[y]
        far = x != y
        if not far.any():
            return root
        x, y = x[far], y[far]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def forest(n: int, pairs) -> np.ndarray:
    """Smallest member of each node's component; ``pairs`` gives blocks of links."""
    root = np.arange(n)
    for x, y in pairs:
        root = merged(root, x, y)
    return root


def finer_masks(mask: int, budget: int) -> list[int]:
    """Masks that fix more bits than ``mask``: a pair within the budget that agrees on it agrees on one of them."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    n = budget + 1
    cuts = [len(free) * i // n for i in range(n + 1)]
    return sorted({mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])})


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def deals(nodes: DataFrame, masks: list[int], budget: int) -> DataFrame:
    """(_fp, mask, held) with every pair within the budget together in some deal (mask, held); large deals are split."""
    done = None
    rows = nodes.select("_fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    for level in range(LEVELS + 1):
        rows = rows.withColumn("held", F.col("_fp").bitwiseAND(F.col("mask")))
        if level == LEVELS:
            break
        # at most (rows / DEAL) of them
        large = rows.groupBy("mask", "held").agg(F.count("*").alias("n")).where((F.col("n") > DEAL) & (F.col("mask") != -1)).drop("n").checkpoint()
        finer = {m: finer_masks(m, budget) for m in masks}
        if not large.count():
            break
        few = F.broadcast(large)
        small = rows.join(few, ["mask", "held"], "left_anti").select("_fp", "mask", "held")
        done = small if done is None else done.unionByName(small)
        again = F.create_map(*[x for m, fs in finer.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(f)) for f in fs]))])
        rows = rows.join(few, ["mask", "held"], "left_semi").select("_fp", F.explode(F.try_element_at(again, F.col("mask"))).alias("mask")).checkpoint()
        masks = sorted({f for fs in finer.values() for f in fs})
    rows = rows.select("_fp", "mask", "held")
    return rows if done is None else done.unionByName(rows)


def links(nodes: DataFrame, budget: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``_fp``, a forest per deal, that join just what lies within the budget."""
    n_nodes = nodes.count()
    masks = block_masks(budget, n_nodes)
    dealt = deals(nodes.select("_fp"), masks, budget).select("_fp", F.col("mask").alias("deal"), "held")
    dealt = dealt.repartition(max(1, len(masks) * n_nodes // TASK_NODES), "deal", "held").sortWithinPartitions("deal", "held")

    def join(batches):
        """Deals come one after the other."""
        key, group = None, []

        def close():
            if len(group) < 2:
                return None
            fps = np.unique(np.array(group, np.int64).view(np.uint64))  # finer deals may meet from two sides
            root = forest(len(fps), trie_pairs(fps, budget))
            child = np.flatnonzero(root != np.arange(len(fps)))
            return (fps[child].view(np.int64), fps[root[child]].view(np.int64)) if len(child) else None

        out: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            fp, deal, held = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            cuts = np.flatnonzero(np.r_[True, (deal[1:] != deal[:-1]) | (held[1:] != held[:-1])])
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(fp)]):
                now = (deal[a], held[a])
                if now != key:
                    if len(group) > 1 and (x := close()):
                        out.append(x)
                    key, group = now, []
                group.extend(fp[a:z].tolist())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["a", "b"])
                out = []
        if x := close():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["a", "b"])

    return map_batches(dealt, join, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): alternating large-star and small-star until nothing moves.

    Each round reads the last one from the checkpoint folder; partial minima are taken before the shuffle. A hub's
    links meet no other row of the hub in one place: its minimum is aggregated and joined back."""
    shared_folder(edges.sparkSession)

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        turned = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        around = both.unionByName(turned) if large else both.where("v < u").unionByName(turned.where("v < u"))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = around.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a != b").distinct()

    edges = edges.checkpoint()
    before = None
    while True:
        edges = star(star(edges, True), False).checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def component_ids(marked: DataFrame, budget: int) -> DataFrame:
    """(_fp, component_id) for the fingerprints of ``marked`` (doc_id, _fp)."""
    nodes = marked.groupBy("_fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("_fp"), budget))
    of = nodes.join(roots, nodes["_fp"] == roots["node"], "left").select("_fp", "least", F.coalesce("root", "_fp").alias("root"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return of.join(ids, "root").select("_fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 5, budget: int = 2) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable
    by links of at most ``budget`` differing bits.

    A null or empty text has fingerprint zero and links like any other; rows of equal fingerprint link whatever
    their doc_id; a null doc_id is a row like any other and never the component's id unless all are null. Other
    columns are not read."""
    shared_folder(docs.sparkSession)
    marked = fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), shingle).select("doc_id", "_fp").checkpoint()
    found = component_ids(marked, budget)
    return marked.join(found, "_fp").select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def apart(docs: DataFrame, row: str) -> DataFrame:
    """doc_id (long), text, and the whole row as one column, whose names meet no others."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row))


def together(rows: DataFrame, row: str, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col(row)[c].alias(c) for c in columns))


def keep_one(docs: DataFrame, shingle: int = 5, budget: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one of smallest doc_id (of rows that repeat it, one).
    Rows without a doc_id stay. Columns stay as they are."""
    shared_folder(docs.sparkSession)
    row, = unused(["doc_id", "text", "_fp"], "row")
    whole = fingerprints(apart(docs, row), shingle)
    marked = whole.select("doc_id", "_fp").where(F.col("doc_id").isNotNull()).checkpoint()
    of = marked.join(component_ids(marked, budget), "_fp")
    kept = of.groupBy("component_id").agg(F.min(F.struct("doc_id", "_fp")).alias("k")).select(F.col("k.doc_id").alias("doc_id"), F.col("k._fp").alias("_fp"))
    stay = whole.where(F.col("doc_id").isNotNull()).join(kept, ["doc_id", "_fp"], "left_semi").dropDuplicates(["doc_id", "_fp"])
    return together(stay.unionByName(whole.where(F.col("doc_id").isNull())), row, docs.columns)


#: 64-bit fingerprints of a shingle set: bits enough for the deals, and to tell a pair's similarity by.
PRINTS = 16
PRINT_BITS = PRINTS * BITS
#: Bits that are compared where sets meet: two of the fingerprints.
NEAR_BITS = 2 * BITS
#: The chance that a pair of just the similarity meets nowhere, and nodes of a deal: on average at most, and at once.
MISSED, DEALT, AT_ONCE = 2e-4, 8192, 16_384
#: Shingles from which a set counts as large: no few hashes decide its bits.
LARGE_SET = 64
#: Nodes of all deals that a task gets on average.
TASK_DEALT = 200_000
STEPS = np.random.default_rng(42).integers(0, 1 << 64, PRINTS, np.uint64)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct shingle hashes, in order."""
    return np.unique(shingle_hashes(text, shingle).astype(np.uint64))


def set_prints(found: np.ndarray) -> np.ndarray:
    """The set's ``PRINTS`` SimHash fingerprints, each over another mix of its hashes: a bit is 1 if set in over half of
    the mixed hashes, and in a tie as in one of the first, another for each fingerprint. Those of an empty set are zero."""
    ones, first = np.zeros(PRINT_BITS, np.int64), 0
    for at in range(0, len(found), 255):
        z = found[at : at + 255, None] + STEPS
        z = (z ^ z >> 30) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> 27) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((z ^ z >> 31).view(np.uint8), axis=1)
        ones += bits.view(np.uint64).sum(0, dtype=np.uint64).view(np.uint8)  # 8 counters of up to 255 in a number
        if not at:
            first = bits.reshape(-1, PRINTS, BITS)[(found[:255, None] ^ STEPS).argmin(0), np.arange(PRINTS)].ravel()
    return np.packbits(2 * ones + first > len(found)).view(np.uint64)


def angle(similarity: float) -> float:
    """The chance that a bit differs between two large sets of this Jaccard similarity: the angle between them over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@cache
def differing(similarity: float) -> float:
    """The largest chance that a bit of the fingerprints differs between two sets of at least this Jaccard similarity.

    Small sets, where few hashes decide a bit, are counted out."""
    worst = angle(similarity)
    for both in range(1, 51):
        extra = min(50 - both, int(both / similarity - both + 1e-9))
        for a, b in ((a, b) for a in range(extra + 1) for b in range(a, extra + 1 - a) if b):

            def one(more):
                """By the bits set among the shared hashes: the chance that the set has a 1."""
                n = np.arange(more + 1)
                lead = 2 * (np.arange(both + 1)[:, None] + n) - both - more
                return ((lead > 0) + 0.5 * (lead == 0)) @ np.array([math.comb(more, k) / 2**more for k in n])

            x, y = one(a), one(b)
            worst = max(worst, float(np.array([math.comb(both, k) / 2**both for k in range(both + 1)]) @ (x * (1 - y) + y * (1 - x))))
    return worst


def reach(p: float, bits: int, errors: float) -> int:
    """Bits, of ``bits``, that differ if each does with the chance ``p``, but for ``errors`` standard errors."""
    return int(bits * p + errors * math.sqrt(bits * p * (1 - p)))


def near_reach(similarity: float) -> int:
    return reach(differing(similarity), NEAR_BITS, 2.5)


def print_reach(similarity: float, large: bool = False) -> int:
    """The bits that all fingerprints of sets of the similarity differ in at most; ``large``: both have ``LARGE_SET``."""
    return reach(1.02 * angle(similarity), PRINT_BITS, 5) if large else reach(differing(similarity), PRINT_BITS, 6)


def apart_by(prints: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Differing bits between rows of fingerprints and those of ``one``."""
    return np.bitwise_count(prints ^ one).sum(-1, dtype=np.int64)


def prints_of(column) -> np.ndarray:
    """A column of fingerprints as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, PRINTS)


def set_keys(docs: DataFrame, shingle: int, prints: bool = False) -> DataFrame:
    """``docs`` with ``_key``, a 64-bit hash of the shingle set; if asked, also ``_size`` of the set and its ``_prints``."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "_key long", *(["_size long", "_prints binary"] if prints else [])])

    def run(batches):
        for b in batches:
            keys, sizes, held = [], [], []
            for at in range(0, b.num_rows, 256):
                for t in texts(b.slice(at, 256)):
                    found = shingle_set(t, shingle)
                    keys.append(xxhash.xxh3_64_intdigest(found.tobytes()))
                    if prints:
                        sizes.append(len(found))
                        held.append(set_prints(found).tobytes())
            more = [pa.array(np.array(keys, np.uint64).view(np.int64))]
            if prints:
                more += [pa.array(sizes, pa.int64()), pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "_key", "_size", "_prints"][: b.num_columns + len(more)])

    return map_batches(docs, run, schema)


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets have a Jaccard similarity of at least ``similarity``."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of keys whose shingle sets are similar enough, by the texts of the nodes' first documents."""
    pairs = pairs.checkpoint()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("_key")).distinct().join(nodes.select("_key", F.col("least").alias("doc_id")), "_key")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    found = set_keys(some, shingle).join(wanted, ["doc_id", "_key"], "left_semi").dropDuplicates(["_key"]).select("_key", "text").checkpoint()
    joined = pairs.join(found.select(F.col("_key").alias("a"), F.col("text").alias("_a")), "a").join(found.select(F.col("_key").alias("b"), F.col("text").alias("_b")), "b")

    def run(batches):
        key, last = None, None
        for b in batches:
            keep = []
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for of, x, y in zip(part.column(1).to_pylist(), texts(part, "_a"), texts(part, "_b")):
                    if of != key:  # pairs of a hub mostly come together
                        key, last = of, shingle_set(y, shingle)
                    keep.append(alike(shingle_set(x, shingle), last, similarity))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(joined.select("a", "b", "_a", "_b"), run, "a long, b long").checkpoint()


def partners(prints: np.ndarray, sizes: np.ndarray, similarity: float, second: np.ndarray | None = None, deal: int = 0, places: np.ndarray | None = None):
    """A function of a set i and others that leaves those which i is to be compared with: the fingerprints don't rule
    them out, they were not met in the bucket before (both are ``second`` here), nor in a deal before ``deal``."""
    most, of_large, near = print_reach(similarity), print_reach(similarity, True), near_reach(similarity)
    before = np.column_stack([x for _, x in islice(dealt_out(prints, places), deal)]) if deal else None
    two = np.arange(deal) % (PRINTS // 2)

    def of(i: int, other: np.ndarray) -> np.ndarray:
        if second is not None:
            other = other[(second[other] & second[i]) == 0]
        far = np.bitwise_count(prints[other] ^ prints[i])
        ok = far.sum(1, dtype=np.int64) <= np.where(np.minimum(sizes[other], sizes[i]) >= LARGE_SET, of_large, most)
        other, far = other[ok], far[ok]
        if deal and len(other):
            close = far.reshape(-1, PRINTS // 2, 2).sum(2, dtype=np.int64) <= near
            other = other[~((before[other] == before[i]) & close[:, two]).any(1)]
        return other

    return of


def linked(sets: list[np.ndarray], roots: list[int], similarity: float, second: list[int] | None = None, deal: int = 0, places: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) between sets of different roots that are similar enough: a forest that joins what all such links
    would, of pairs that are not compared elsewhere (``partners``)."""
    number = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    group = np.array([number[r] for r in roots])
    if len(number) < 2:
        return []
    of = partners(np.stack([set_prints(x) for x in sets]), np.array([len(x) for x in sets]), similarity, None if second is None else np.array(second), deal, places)
    out = []
    for i in range(1, len(sets)):
        other = np.flatnonzero(group[:i] != group[i])
        if not len(other):
            continue
        for j in of(i, other).tolist():
            if group[j] != group[i] and alike(sets[i], sets[j], similarity):
                out.append((i, j))
                group[group == group[i]] = group[j]
    return out


#: Bytes of sets, and sets, that a block of a band's sets holds.
BLOCK_BYTES, BLOCK_SETS = 32_000_000, 10_000


def alike_by_prints(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b, large) of keys whose fingerprints don't rule them out. These are short, whatever the texts."""
    prints = nodes.select("_key", "_prints")
    met = pairs.join(prints.withColumnsRenamed({"_key": "a", "_prints": "_a"}), "a").join(prints.withColumnsRenamed({"_key": "b", "_prints": "_b"}), "b")
    most, of_large = print_reach(similarity), print_reach(similarity, True)

    def run(batches):
        for b in batches:
            x, y = (prints_of(b.column(c)) for c in (2, 3))
            keep = apart_by(x, y) <= np.where(b.column(4).to_numpy(zero_copy_only=False), of_large, most)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(met.select("a", "b", "_a", "_b", "large"), run, "a long, b long")


def with_partners(dealt: DataFrame, nodes: DataFrame, keys: tuple[str, ...], similarity: float, places: np.ndarray) -> DataFrame:
    """The rows of ``dealt`` (``keys``, _key, root, second) that have, within their ``keys``, a row of another root that
    they are to be compared with (``partners``)."""
    met = dealt.join(nodes.select("_key", "_size", "_prints"), "_key").select(*keys, "_key", "root", "second", "_size", "_prints").repartition(*keys).sortWithinPartitions(*keys, "_key")
    names = [*keys, "_key", "root", "second"]

    def compare(batches):
        last, group = None, []

        def close():
            rows = []
            root = np.unique(np.array([r[-4] for r in group], np.int64), return_inverse=True)[1]
            if len(group) > 1 and root.any():
                prints = np.frombuffer(b"".join(r[-1] for r in group), np.uint64).reshape(len(group), -1)
                of = partners(prints, np.array([r[-2] for r in group]), similarity, np.array([r[-3] for r in group]), last[0] & 0xFFFF, places)
                wanted = np.zeros(len(group), bool)
                for i in range(1, len(group)):
                    near = of(i, np.flatnonzero((root[:i] != root[i]) & ~(wanted[:i] & wanted[i])))
                    wanted[near] = True
                    wanted[i] |= len(near) > 0
                rows = [r[:-2] for r, w in zip(group, wanted) if w]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if n in ("i", "j", "second") else pa.int64()) for k, n in enumerate(names)], names=names)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[: len(keys)] != last:
                    yield close()
                    last, group = row[: len(keys)], []
                group.append(row)
        yield close()

    return map_batches(met, compare, "band long, bucket long, i int, j int, _key long, root long, second int")


def links_in_bands(placed: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float, places: np.ndarray) -> DataFrame:
    """Links (a, b) between similar enough sets of different roots that share a band (``placed``: band, _key, _size, root).

    Sets of a band meet by size, in steps of which similar ones are at most one apart, and in pairs of blocks of bounded
    bytes: first by their fingerprints, then, of what has a partner there, whole. They are compared in the task, which gives a
    forest; pairs are no rows. A pair that meets in several deals or steps is compared in the first."""
    step = np.log(1 / min(similarity, 0.999))
    sized = placed.withColumn("second", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("bucket", F.floor(F.log("_size") / F.lit(float(step))).cast("int") + F.col("second"))
    blocks = sized.groupBy("band", "bucket").agg((F.floor(F.greatest(F.sum("_size") * 8 / BLOCK_BYTES, F.count("*") / BLOCK_SETS)) + 1).cast("int").alias("blocks"), F.countDistinct("root").alias("roots")).where("roots > 1").drop("roots")
    own = F.pmod(F.xxhash64("_key"), F.col("blocks")).cast("int")
    dealt = sized.join(blocks, ["band", "bucket"]).withColumn("own", own).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ("band", "bucket", "i", "j")
    dealt = dealt.select("band", F.col("bucket").cast("long").alias("bucket"), F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "_key", "root", "second")
    dealt = with_partners(dealt, nodes, keys, similarity, places).checkpoint()
    wanted = dealt.select("_key").distinct().join(nodes.select("_key", F.col("least").alias("doc_id")), "_key")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")

    def make(batches):
        for b in batches:
            found = [shingle_set(t, shingle).tobytes() for t in texts(b)]
            keys = np.array([xxhash.xxh3_64_intdigest(x) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(found, pa.binary())], names=["_key", "_set"])

    sets = map_batches(some, make, "_key long, _set binary").join(wanted.select("_key"), "_key", "left_semi").dropDuplicates(["_key"])
    met = dealt.join(sets, "_key").select(*keys, "_key", "root", "second", "_set").repartition(*keys).sortWithinPartitions(*keys, "_key")

    def compare(batches):
        last, group = None, []

        def close():
            found = []
            if len(group) > 1:
                _, roots, second, held = zip(*group)
                found = linked([np.frombuffer(x, np.uint64) for x in held], list(roots), similarity, list(second), last[0] & 0xFFFF, places)
            return pa.RecordBatch.from_arrays([pa.array([group[i][0] for i, _ in found], pa.int64()), pa.array([group[j][0] for _, j in found], pa.int64())], names=["a", "b"])

        for b in batches:
            for band, bucket, i, j, key, root, second, held in zip(*(c.to_pylist() for c in b.columns)):
                if (now := (band, bucket, i, j)) != last:
                    yield close()
                    last, group = now, []
                group.append((key, root, second, held))
        yield close()

    return map_batches(met, compare, "a long, b long").distinct().checkpoint()


def print_deals(n_nodes: int, similarity: float) -> np.ndarray:
    """Per deal the places of the bits by which it tells sets apart: so many that a deal holds ``DEALT`` nodes on average
    at most, and so many deals that a pair of the similarity meets in none with a chance of ``MISSED``."""
    p, near = differing(similarity), near_reach(similarity)
    n_bits = max(0, math.ceil(math.log2(max(1, n_nodes) / DEALT)))
    within = sum(math.comb(NEAR_BITS, k) * p**k * (1 - p) ** (NEAR_BITS - k) for k in range(near + 1))
    met = (1 - p) ** n_bits * within
    n_deals = max(1, math.ceil(math.log(MISSED) / math.log1p(-met)))
    rounds = -(-n_deals * n_bits // PRINT_BITS)  # every bit is in one deal before any is in two
    places = [np.random.default_rng(k).permutation(PRINT_BITS) for k in range(max(1, rounds))]
    return np.concatenate(places)[: n_deals * n_bits].reshape(n_deals, n_bits)


def dealt_out(prints: np.ndarray, places: np.ndarray):
    """Per deal: its number and the nodes' keys within all deals (number and bits in one)."""
    bits = np.unpackbits(prints.view(np.uint8), axis=1)
    for d, at in enumerate(places):
        yield d, bits[:, at].astype(np.int64) @ (np.int64(1) << np.arange(len(at), dtype=np.int64)) + (np.int64(d) << 40)


def gathered(batches, size: int):
    """(keys, fingerprints) of about ``size`` nodes (_key, _prints) each."""
    keys, prints, held = [], [], 0
    for b in batches:
        keys.append(b.column(0).to_numpy())
        prints.append(prints_of(b.column(1)))
        held += b.num_rows
        if held >= size:
            yield np.concatenate(keys), np.concatenate(prints)
            keys, prints, held = [], [], 0
    if held:
        yield np.concatenate(keys), np.concatenate(prints)


def large_deals(nodes: DataFrame, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The deals of more than ``AT_ONCE`` nodes, in order, and in how many blocks each is compared. They are at most
    a twice ``DEALT``-th of all nodes dealt, and none unless many sets are alike."""

    def run(batches):
        for _, prints in gathered(batches, 16_384):
            for _, deal in dealt_out(prints, places):
                found, n = np.unique(deal, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["deal", "n"])

    sizes = map_batches(nodes.select("_key", "_prints"), run, "deal long, n long").groupBy("deal").agg(F.sum("n").alias("n"))
    found = sorted((r["deal"], r["n"] // AT_ONCE + 1) for r in sizes.where(F.col("n") > AT_ONCE).collect())
    return np.array([d for d, _ in found], np.int64), np.array([n for _, n in found], np.int64)


def close_sets(dealt: DataFrame, keys: tuple[str, ...], similarity: float) -> DataFrame:
    """(band, _key): per group of ``keys`` in ``dealt`` (``keys``, held[, root]) what lies together, a band being joined by
    pairs of different roots within the Hamming budget; its last 16 bits are the deal's number. ``held`` has nodes of 24 bytes: key and two fingerprints.

    All pairs of a group are compared, but for those that are in one band already."""
    dealt = dealt.sortWithinPartitions(*keys)
    near = near_reach(similarity)

    def compare(batches):
        last, group, roots = None, [], []

        def close():
            rows = np.frombuffer(b"".join(group), np.uint64).reshape(-1, 3)
            at, n, a, step = np.arange(len(rows)), len(rows), 0, 16
            root = np.array(roots) if roots else at
            x, y = np.ascontiguousarray(rows[:, 1]), np.ascontiguousarray(rows[:, 2])
            while a < n - 1:
                z = min(n, a + step)
                met = np.bitwise_count(x[a:z, None] ^ x[a:]) + np.bitwise_count(y[a:z, None] ^ y[a:]) <= near
                met &= at[a:z, None] != at[a:]
                if roots:
                    met &= root[a:z, None] != root[a:]
                i, j = np.nonzero(met)
                if len(i):
                    at = merged(at, i + a, j + a)
                a, step = z, 256
            names, number, count = np.unique(at, return_inverse=True, return_counts=True)
            wanted = np.flatnonzero(count[number] > 1)
            bands = np.array([xxhash.xxh64_intdigest(repr((*last, k)).encode()) & ~0xFFFF | last[0] >> 40 if c > 1 else 0 for k, c in zip(names.tolist(), count.tolist())], np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(bands[number[wanted]].view(np.int64)), pa.array(rows[wanted, 0].view(np.int64))], names=["band", "_key"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[: len(keys)] != last:
                    if group:
                        yield close()
                    last, group, roots = row[: len(keys)], [], []
                group.append(row[len(keys)])
                roots.extend(row[len(keys) + 1 :])
        if group:
            yield close()

    return map_batches(dealt, compare, "band long, _key long")


def close_in_deals(nodes: DataFrame, places: np.ndarray, large: tuple[np.ndarray, np.ndarray], similarity: float) -> DataFrame:
    """(band, _key) of the ``nodes`` that lie within the Hamming budget in a deal, or in one block of a large deal."""

    def run(batches):
        for key, prints in gathered(batches, 16_384):
            for d, deal in dealt_out(prints, places):
                block = np.zeros(len(deal), np.int64)
                if len(large[0]):
                    k = np.minimum(np.searchsorted(large[0], deal), len(large[0]) - 1)
                    block = np.where(large[0][k] == deal, key % large[1][k], 0)
                order = np.lexsort((block, deal))
                deal, block = deal[order], block[order]
                rows = np.column_stack([key.view(np.uint64), prints[:, 2 * d % PRINTS], prints[:, (2 * d + 1) % PRINTS]])[order].tobytes()
                cuts = np.flatnonzero(np.r_[True, (deal[1:] != deal[:-1]) | (block[1:] != block[:-1])])
                held = [rows[24 * a : 24 * z] for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(deal)])]
                yield pa.RecordBatch.from_arrays([pa.array(deal[cuts]), pa.array(block[cuts]), pa.array(held, pa.binary())], names=["deal", "block", "held"])

    dealt = map_batches(nodes.select("_key", "_prints"), run, "deal long, block long, held binary")
    return close_sets(dealt.repartition(max(1, len(places) * nodes.count() // TASK_DEALT), "deal", "block"), ("deal", "block"), similarity)


def close_across(nodes: DataFrame, roots: DataFrame, places: np.ndarray, large: tuple[np.ndarray, np.ndarray], similarity: float) -> DataFrame:
    """(band, _key) of the ``nodes`` in large deals that lie within the Hamming budget of one of another root.

    Most nodes of a large deal have one root by now. Blocks of these meet blocks of the others, which meet one another
    too; so rows grow with the large group, not with its square."""

    def run(batches):
        for key, prints in gathered(batches, 16_384):
            for d, deal in dealt_out(prints, places):
                k = np.flatnonzero(np.isin(deal, large[0]))
                rows = np.column_stack([key.view(np.uint64), prints[:, 2 * d % PRINTS], prints[:, (2 * d + 1) % PRINTS]])[k].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(deal[k]), pa.array(key[k]), pa.array([rows[24 * a : 24 * a + 24] for a in range(len(k))], pa.binary())], names=["deal", "_key", "held"])

    dealt = map_batches(nodes.select("_key", "_prints"), run, "deal long, _key long, held binary")
    dealt = dealt.join(roots.withColumnsRenamed({"node": "_key"}), "_key", "left").withColumn("root", F.coalesce("root", "_key")).checkpoint()
    most = dealt.groupBy("deal", "root").agg(F.count("*").alias("n")).groupBy("deal").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("n"))
    blocks = lambda n: F.floor(n / AT_ONCE).cast("int") + 1
    most = most.where("n > m.n").select("deal", F.col("m.root").alias("main"), blocks(F.col("m.n")).alias("of_main"), blocks(F.col("n") - F.col("m.n")).alias("of_rest"))
    met = dealt.join(most, "deal")
    own = lambda n: F.pmod(F.xxhash64("_key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    main = met.where("root = main").select("deal", own("of_main").alias("i"), every("of_rest").alias("j"), "held", "root")
    rest = met.where("root != main").withColumn("own", own("of_rest"))
    to_main = rest.select("deal", every("of_main").alias("i"), F.col("own").alias("j"), "held", "root")
    among = rest.withColumn("x", every("of_rest")).select("deal", (-1 - F.least("own", "x")).alias("i"), F.greatest("own", "x").alias("j"), "held", "root")
    return close_sets(main.unionByName(to_main).unionByName(among).repartition("deal", "i", "j"), ("deal", "i", "j"), similarity)


def similar_sets(nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root) of the ``nodes`` (_key, least, _size, _prints) that are linked to others: the components of all
    pairs that lie in a band and are similar enough.

    Bands come from SimHash: in each of several deals, sets that agree on the deal's bits meet, and those within the
    Hamming budget of two fingerprints lie in a band. First each node is compared with the least of its band; then, of
    what shares a band, the sets that this left in different components, in the tasks (``links_in_bands``). So a large
    group of near copies takes few comparisons, and no pair is left out. Deals of too many nodes are compared in blocks
    and, once these are linked, across them."""
    # a set is similar to one that has a shingle more, or to none but its equals
    able = nodes.where(F.col("_size") * (1 - similarity) >= similarity - 1e-9).where("_size > 0").select("_key", "_prints")
    places = print_deals(able.count(), similarity)
    large = large_deals(able, places)
    sizes = nodes.select("_key", "_size")
    dealt = close_in_deals(able, places, large, similarity).join(sizes, "_key").checkpoint()
    hubs = dealt.groupBy("band").agg(F.min(F.struct("_key", "_size")).alias("h")).select("band", F.col("h._key").alias("hub"), F.col("h._size").alias("hub_size"))
    met = dealt.join(hubs, "band").checkpoint()
    fits = F.least("_size", "hub_size") >= similarity * F.greatest("_size", "hub_size") - 1e-9
    to_hub = met.where((F.col("_key") != F.col("hub")) & fits).select(F.col("_key").alias("a"), F.col("hub").alias("b"), (F.least("_size", "hub_size") >= LARGE_SET).alias("large")).distinct()
    roots = components(confirmed(alike_by_prints(to_hub, nodes, similarity), nodes, docs, shingle, similarity))
    placed = met.join(roots, met["_key"] == roots["node"], "left").select("band", "_key", "_size", "hub", F.coalesce("root", "_key").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("band")
    placed = placed.where("_key != hub").join(mixed, "band").select("band", "_key", "_size", "root").checkpoint()

    def joined(roots: DataFrame, placed: DataFrame) -> DataFrame:
        more = links_in_bands(placed, nodes, docs, shingle, similarity, places)
        return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    roots = joined(roots, placed)
    if len(large[0]):
        across = close_across(able, roots, places, large, similarity).join(sizes, "_key")
        placed = across.join(roots, across["_key"] == roots["node"], "left").select("band", "_key", "_size", F.coalesce("root", "_key").alias("root")).checkpoint()
        roots = joined(roots, placed)
    return roots


def keep_one_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of documents linked by a Jaccard similarity of at least ``similarity`` between
    their shingle sets, the one of smallest doc_id (of rows that repeat it, one). Texts without words are alike. Rows
    without a doc_id stay. Columns stay as they are."""
    shared_folder(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    nodes = set_keys(source, shingle, prints=True).drop("text").groupBy("_key").agg(F.min("doc_id").alias("least"), F.first("_size").alias("_size"), F.first("_prints").alias("_prints")).checkpoint()
    roots = similar_sets(nodes, docs, shingle, similarity)
    of = nodes.join(roots, nodes["_key"] == roots["node"], "left").select("least", "_key", F.coalesce("root", "_key").alias("root"))
    kept = of.groupBy("root").agg(F.min(F.struct("least", "_key")).alias("k")).select(F.col("k.least").alias("doc_id"), F.col("k._key").alias("_key"))
    row, = unused(["doc_id", "text", "_key"], "row")
    rows = apart(docs, row)
    whole = set_keys(rows.where(F.col("doc_id").isNotNull()), shingle)
    stay = whole.join(kept, ["doc_id", "_key"], "left_semi").dropDuplicates(["doc_id", "_key"]).drop("_key")
    return together(stay.unionByName(rows.where(F.col("doc_id").isNull())), row, docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, budget=2)
