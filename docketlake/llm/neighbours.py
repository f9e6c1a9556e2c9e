"""Approximate nearest neighbours by an inverted multi-index.

The halves of the vectors are quantised apart; a pair of centroids is a cell. A query walks the pairs by the sum of
both distances with a heap until the cells hold enough entries, and all of these are ranked by the exact distance.
How many are enough is measured: a bounded number of trial queries is compared with all entries in one scan, and the
walk goes as deep as these need for the asked recall.

Equal vectors are one entry with its smallest ids, as many as a query can use (equally near, smaller ids win), so a
vector that a third of the rows share costs no more than another. Cells are cut, or put together, into groups of
bounded size before they meet the queries that visit them; each group gives its nearest few per query, from the cells
that the query visits, and a top-k over these ends it.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketlake.llm.common import map_batches, ship_package, shared_folder, table

#: Vectors that the centroids are fitted on at most, and steps of k-means.
SAMPLE, STEPS = 20_000, 12
#: How many entries a query's cells must hold is measured: enough for this recall on some queries, at least so many.
RECALL, CANDIDATES, TRIALS = 0.94, 1_000, 256
#: Centroids of a half at most: the square of it is the number of cells, whose sizes reach the driver.
SIDE_BITS = 10
CELL_BLOCK, QUERY_BLOCK = 4_096, 20_000


def kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of the rows, from evenly spaced ones."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(STEPS):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, 1)


def pairs_by_distance(first: np.ndarray, second: np.ndarray):
    """Pairs (i, j) by the sum of their distances, least first, with a heap (multi-sequence walk)."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, pushed = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))


class MultiIndex:
    """Centroids of both halves and how many entries each cell has."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        self.centres = kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half :], k)
        self.sizes: dict[int, int] = {}

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.centres[0]) * len(self.centres[1]) + nearest(x[:, self.half :], self.centres[1])

    def visit(self, q: np.ndarray, wanted: int) -> list[int]:
        """Cells for a query, until they hold ``wanted`` entries."""
        parts = (q[: self.half], q[self.half :])
        first, second = (((c - p) ** 2).sum(1) for c, p in zip(self.centres, parts))
        out, held = [], 0
        for i, j in pairs_by_distance(first, second):
            cell = i * len(self.centres[1]) + j
            if n := self.sizes.get(cell, 0):
                out.append(cell)
                held += n
                if held >= wanted:
                    break
        return out


def cell_groups(sizes: dict[int, int], block: int) -> dict[int, tuple[int, int]]:
    """For each cell its first group and how many it is cut into; small cells share a group, up to ``block`` entries."""
    out, group, held = {}, 0, 0
    for cell in sorted(sizes):
        n = sizes[cell]
        if n > block:
            group += held > 0
            parts = -(-n // block)
            out[cell], group, held = (group, parts), group + parts, 0
            continue
        if held + n > block:
            group, held = group + 1, 0
        out[cell] = group, 1
        held += n
    return out


def enough(placed: DataFrame, asked: DataFrame, index: MultiIndex, dim: int, k: int, recall: float, trials: int) -> int:
    """Entries that the walk must have met to find the share ``recall`` of the trial queries' true neighbours."""
    rows = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(trials).toArrow()
    x = matrix(rows["embedding"], dim)

    def scan(batches):
        for b in batches:
            e, cells, out = matrix(b.column(0), dim), b.column(1).to_numpy(), [[], [], []]
            for i, q in enumerate(x):
                far = ((e - q) ** 2).sum(1)
                for j in np.argsort(far)[: k + 1]:
                    if far[j] > 0:  # its own entry needs no search
                        for to, v in zip(out, (i, far[j], cells[j])):
                            to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.int64())], names=["trial", "far", "cell"])

    found = map_batches(placed.select("embedding", "cell"), scan, "trial long, far double, cell long")
    order = Window.partitionBy("trial").orderBy("far", "cell")
    true = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("trial", "cell").collect()
    needs, by_trial = [], {}
    for trial, cell in true:
        by_trial.setdefault(trial, []).append(cell)
    for trial, cells in by_trial.items():
        met, held = {}, 0
        for cell in index.visit(x[trial], 1 << 62):
            held += index.sizes[cell]
            met[cell] = held
        needs += [met[c] for c in cells]
    needs.sort()
    return needs[min(len(needs) - 1, int(recall * len(needs)))] if needs else 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of lists as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """Rows whose vector is not null, not zero and has finite components only (of ``dim`` components)."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = e.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(e, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & ok & (F.size(e) == dim if dim else F.lit(True)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """The k nearest rows of ``vectors`` (vec_id, embedding) found for each of ``queries``: query_id, rank, vec_id, score.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose length is not
    the most common one. A row with the query's own vec_id is no candidate. Rows that repeat a vec_id count once per
    distance. Equal distances rank by vec_id; fewer than k rows where there are fewer; empty tables give none."""
    spark = vectors.sparkSession
    shared_folder(spark)
    ship_package(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")))
    dims = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if dims is None:
        return spark.createDataFrame([], schema)
    dim = dims["n"]
    rows = usable(rows, dim)
    # a partial limit keeps k + 1 rows per vector and task before the shuffle
    order = Window.partitionBy("embedding").orderBy("vec_id")
    entries = rows.distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).checkpoint()
    n = entries.count()
    chosen = entries.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(sample).toArrow()
    side = 2 ** int(np.clip(round(np.log2(max(1.0, np.sqrt(n / 64)))), 2, SIDE_BITS))
    index = MultiIndex(matrix(chosen["embedding"], dim), side)

    def assign(batches):
        for b in batches:
            x = matrix(b.column(0), dim)
            cells = index.cells(x) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.int64())], names=["embedding", "ids", "cell"])

    placed = map_batches(entries, assign, "embedding array<double>, ids array<long>, cell long")
    index.sizes = {r[0]: r[1] for r in placed.groupBy("cell").count().collect()}  # at most side ** 2 rows
    asked = usable(queries.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")), dim).distinct()
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    wanted = max(CANDIDATES, k + 1, enough(placed, asked, index, dim, k, recall, TRIALS))
    groups = cell_groups(index.sizes, CELL_BLOCK)

    def route(batches):
        for b in batches:
            at, group, cells = [], [], []
            for i, q in enumerate(matrix(b.column(1), dim)):
                visits: dict[int, list[int]] = {}
                for cell in index.visit(q, wanted):
                    first, parts = groups[cell]
                    for g in range(first, first + parts):
                        visits.setdefault(g, []).append(cell)
                at += [i] * len(visits)
                group += visits.keys()
                cells += visits.values()
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(group, pa.int64()), pa.array(cells, pa.list_(pa.int64()))], names=["query_id", "query", "group", "cells"])

    def deal(batches):
        for b in assign(batches):
            x, cells = matrix(b.column(0), dim), b.column(2).to_pylist()
            group = [groups[c][0] + (zlib.crc32(v.tobytes()) % groups[c][1]) for c, v in zip(cells, x)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(group, pa.int64())], names=["embedding", "ids", "cell", "group"])

    routed = map_batches(asked, route, "query_id long, query array<double>, group long, cells array<long>").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    dealt = map_batches(entries, deal, "embedding array<double>, ids array<long>, cell long, group long").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            whole, whole_ids, cell = matrix(left["embedding"], dim), np.array(left["ids"].to_pylist() + [None], object)[:-1], left["cell"].to_numpy()
            for query_id, cells, q in zip(right["query_id"].to_pylist(), right["cells"].to_pylist(), matrix(right["query"], dim)):
                met = np.flatnonzero(np.isin(cell, cells))
                far = np.sqrt(((whole[met] - q) ** 2).sum(1))
                # entries up to the distance of the (k + 1)-th: ties stay
                cut = np.partition(far, k)[k] if len(far) > k + 1 else np.inf
                near = sorted((float(far[i]), v) for i in np.flatnonzero(far <= cut) for v in whole_ids[met[i]] if v != query_id)[:k]
                for d, v in near:
                    for to, value in zip(out, (query_id, v, d)):
                        to.append(value)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    keys = ("group", "block")
    near = dealt.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(rank, "query_id long, vec_id long, score double")
    best = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)
