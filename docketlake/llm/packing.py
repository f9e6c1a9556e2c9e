"""Packing documents into sequences: online best fit with a fixed number of open bins.

The map encodes each document, ends it with the end id, cuts only what is longer than a sequence, and sends on
one small row per piece, never texts or ids. The pieces are dealt evenly over partitions, and there, by a hash, over
rounds of about as many documents as there are open bins. Rounds come one after the other, each with its longest pieces
first: what opens bins comes before what fills them, and few bins close for lack of space. A partition packs its
pieces with ``BestFit``, whose memory is fixed. Lost tasks give the same rows when they run again: rows that tie in all
columns of the order are alike.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.llm import bpe
from docketlake.llm.common import map_batches, table, texts

CAPACITY, END_ID, OPEN_BINS, DOCS_PER_PARTITION = 4096, 1, 4096, 40_000


class BestFit:
    """Bounded-space best fit: bins by free space, and a bitset of the free spaces that open bins have."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits, self.n_open, self.n_bins = 0, 0, 0

    def _take(self, space: int) -> int:
        found = self.by_space[space]
        number = found.pop()
        if not found:
            self.bits ^= 1 << space
        self.n_open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """Bin number and offset for a piece of 1 to ``capacity`` tokens."""
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.n_open >= self.open_bins:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            space, number = self.capacity, self.n_bins
            self.n_bins += 1
        if left := space - length:
            if not self.by_space[left]:
                self.bits |= 1 << left
            self.by_space[left].append(number)
            self.n_open += 1
        return number, self.capacity - space


def document_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. A null or empty text is one piece of the end id alone;
    repeated rows give repeated pieces; other columns are not read."""

    def run(batches):
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, found in zip(b.column(0).to_pylist(), bpe.encoder(path).of(texts(b))):
                ids = np.append(found, np.uint32(end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    cut = ids[start : start + capacity]
                    for to, x in zip(rows, (doc_id, k, start, len(cut), zlib.crc32(cut.tobytes()))):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, n_partitions: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, rounds: int = 1) -> DataFrame:
    """``pieces`` (as of ``document_pieces``, lengths of 1 to ``capacity``) with sequence_id and offset."""
    turn = F.pmod(F.xxhash64("ids_crc32", "doc_id", "piece", "start", "length"), F.lit(max(1, rounds)))
    dealt = pieces.repartition(n_partitions, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions(turn, F.desc("length"), "doc_id", "piece", "start", "ids_crc32")

    def run(batches):
        bins, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 32
        for b in batches:
            placed = [bins.place(n) for n in b.column(b.schema.get_field_index("length")).to_pylist()]
            ids, offsets = ([base + n for n, _ in placed], [at for _, at in placed])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], names=[*b.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return map_batches(dealt, run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS, path: str | None = None) -> DataFrame:
    """Pack whole documents; see ``document_pieces`` for odd rows. An empty table gives no rows."""
    n_docs = docs.count()
    n = max(1, -(-n_docs // DOCS_PER_PARTITION))
    return pack(document_pieces(docs, capacity, end_id, path), n, capacity, open_bins, -(-n_docs // n // open_bins))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
