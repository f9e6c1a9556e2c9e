"""Line dedup: two Bloom filters pick suspects, an exact count confirms them.

1. Each task notes the hashes of its documents' lines in a once-seen and a twice-seen filter; both are cut into
   segments of 2^16 bits and sent as the numbers of the bits set. Segments meet in reducers: what two tasks have
   seen once, or one task twice, is seen twice. No line seen in two documents can be missed.
2. Lines that the twice-seen filter knows are suspects. Only their digests shuffle (counted within the task first)
   for the exact number of documents and the first of them.
3. Lines confirmed as frequent go. Their digests are broadcast while there are at most ``BROADCAST_KEYS``;
   beyond that they are joined to the documents that hold them.

The filters' size follows the number of documents up to ``MAX_BITS``; beyond that more lines are suspected, and the
result stays exact.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import batched, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.llm.common import BLANKS, chunks, map_batches, n_points, shared_folder, ship_package, table, texts, unused

SEGMENT_BITS = 16
MIN_BITS, MAX_BITS, BITS_PER_DOC = 22, 29, 128
BROADCAST_KEYS = 300_000
#: A hash met so often in one call of add() is watched; of those met ``OFTEN`` times in a task the first are told.
OFTEN_IN_GROUP, OFTEN, OFTEN_TOLD = 3, 32, 256
#: Told hashes are added up in so many deals, which keep so many of them together.
OFTEN_DEALS, OFTEN_KEPT = 1024, 65_536
TASK_KEYS = 100_000


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, with A-Z lower-cased."""
    return line.strip(BLANKS).lower()


def document_keys(text: bytes, min_points: int) -> set[bytes]:
    """The distinct keys of a document that can count."""
    keys = {line_key(x) for x in text.split(b"\n")}
    keys.discard(b"")
    return keys if min_points <= 1 else {k for k in keys if n_points(k) >= min_points}


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two bits for each 64-bit hash."""
    mask = np.uint64((1 << bits) - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(32)) & mask])


def hash_keys(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)


class SeenFilters:
    """The once-seen and the twice-seen filter of a task."""

    def __init__(self, bits: int):
        self.bits, self.often = bits, Counter()
        self.once, self.twice = np.zeros(1 << bits >> 3, np.uint8), np.zeros(1 << bits >> 3, np.uint8)

    @staticmethod
    def has(held: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool).all(0)

    @staticmethod
    def put(held: np.ndarray, at: np.ndarray) -> None:
        at = at.ravel()
        np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def add(self, hashes: np.ndarray) -> None:
        """Hashes of some documents, each once per document."""
        hashes, counts = np.unique(hashes, return_counts=True)
        many = np.flatnonzero(counts >= OFTEN_IN_GROUP)
        self.often.update(dict(zip(hashes[many].tolist(), counts[many].tolist())))
        at = positions(hashes, self.bits)
        again = (counts > 1) | self.has(self.once, at)
        self.put(self.twice, at[:, again])
        self.put(self.once, at[:, ~again])

    def segments(self):
        """Per segment with bits set: its number, and the set bits of both filters as 16-bit numbers."""
        step = 1 << SEGMENT_BITS >> 3

        def bits_of(held: np.ndarray) -> bytes:
            return np.flatnonzero(np.unpackbits(held, bitorder="little")).astype("<u2").tobytes() if held.any() else b""

        for i in range(len(self.once) // step):
            once, twice = (bits_of(x[i * step : (i + 1) * step]) for x in (self.once, self.twice))
            if once or twice:
                yield i, once, twice


def twice_seen(docs: DataFrame, bits: int, hashes_of) -> tuple[bytes, np.ndarray]:
    """The twice-seen filter over all documents: ``2 ** bits`` bits, so at most 2 ** (MAX_BITS - 3) bytes. And the
    hashes that tasks met very often, by which callers split hot groups: each task tells at most ``OFTEN_TOLD``, their
    counts are added up by hash, and the most frequent ``OFTEN_KEPT`` reach the driver.

    hashes_of: from some texts to the hashes that they add."""

    def note(batches):
        seen = SeenFilters(bits)
        for b in batches:
            for group in chunks(texts(b)):
                seen.add(hashes_of(group))
        told: dict[int, list] = {}
        for h, n in seen.often.most_common(OFTEN_TOLD):
            if n >= OFTEN:
                told.setdefault(-1 - h % OFTEN_DEALS, []).append((h, n))
        for rows in batched(chain(seen.segments(), ((k, np.array(x, "<u8").tobytes(), b"") for k, x in told.items())), 512):
            number, once, twice = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["segment", "once", "twice"])

    def meet(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        told: dict[int, Counter] = {}
        for b in batches:
            for number, once, twice in zip(*(c.to_pylist() for c in b.columns)):
                if number < 0:
                    for h, n in np.frombuffer(once, "<u8").reshape(-1, 2).tolist():
                        told.setdefault(number, Counter())[h] += n
                    continue
                one, two = held.setdefault(number, (np.zeros(1 << SEGMENT_BITS, bool), np.zeros(1 << SEGMENT_BITS, bool)))
                once, twice = np.frombuffer(once, "<u2"), np.frombuffer(twice, "<u2")
                two[once[one[once]]] = True
                two[twice] = True
                one[once] = True
                one[twice] = True
        for number, found in told.items():
            most = [h for h, _ in found.most_common(OFTEN_KEPT // OFTEN_DEALS)]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([np.array(most, "<u8").tobytes()], pa.binary())], names=["segment", "twice"])
        for number, (_, two) in held.items():
            if two.any():
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([np.packbits(two, bitorder="little").tobytes()], pa.binary())], names=["segment", "twice"])

    noted = map_batches(docs.select("text"), note, "segment int, once binary, twice binary")
    met = map_batches(noted.repartition("segment"), meet, "segment int, twice binary")
    out, step = bytearray(1 << bits >> 3), 1 << SEGMENT_BITS >> 3
    often = [np.zeros(0, np.uint64)]
    for number, twice in met.toLocalIterator():
        if number < 0:
            often.append(np.frombuffer(bytes(twice), "<u8"))
            continue
        out[number * step : (number + 1) * step] = twice
    return bytes(out), np.concatenate(often)


def frequent_keys(docs: DataFrame, min_docs: int = 10, min_points: int = 1) -> DataFrame:
    """Digest (SHA-256), number of documents and smallest doc_id of every line key found in ``min_docs`` documents."""
    bits = min(MAX_BITS, max(MIN_BITS, (docs.count() * BITS_PER_DOC).bit_length()))
    ship_package(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, bits, lambda group: hash_keys(k for t in group for k in document_keys(t, min_points)))[0])

    def suspects(batches):
        held = np.frombuffer(known.value, np.uint8)
        counts, first = Counter(), {}

        def flush():
            keys = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([counts[k] for k in keys], pa.int64()), pa.array([first[k] for k in keys], pa.int64())], names=["key", "n_docs", "first_doc"])
            counts.clear()
            first.clear()
            return out

        for b in batches:
            for doc_id, t in zip(b.column(0).to_pylist(), texts(b)):
                keys = list(document_keys(t, min_points))
                if not keys:
                    continue
                for i in np.flatnonzero(SeenFilters.has(held, positions(hash_keys(keys), bits))):
                    key = hashlib.sha256(keys[i]).digest()
                    counts[key] += 1
                    if doc_id is not None and (first.setdefault(key, doc_id) is None or doc_id < first[key]):
                        first[key] = doc_id
                    first.setdefault(key, None)
            if len(counts) > TASK_KEYS:
                yield flush()
        if counts:
            yield flush()

    found = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), suspects, "key binary, n_docs long, first_doc long")
    return found.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc")).where(F.col("n_docs") >= min_docs)


def split_lines(text: bytes, frequent, keep_here=()) -> tuple[list[bytes], int]:
    """The lines that stay and the number of all lines. ``keep_here``: digests whose first line in this text stays."""
    lines, kept, seen = text.split(b"\n"), [], set()
    for x in lines:
        key = line_key(x)
        if key and (digest := hashlib.sha256(key).digest()) in frequent:
            if digest not in keep_here or digest in seen:
                continue
            seen.add(digest)
        kept.append(x)
    return kept, len(lines)


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_points: int = 1, keep_first: bool = False, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` with ``text`` without its frequent lines, and n_lines, n_dropped (these two names are replaced).

    A line is frequent if its key has at least ``min_points`` code points and is found in ``min_docs`` documents (rows);
    shorter keys never are. keep_first: the first line in the document of smallest doc_id stays. A null or empty text
    is one empty line, and stays null or empty; repeated rows count as documents of their own."""
    spark = docs.sparkSession
    ship_package(spark)
    shared_folder(spark)
    docs = docs.drop("n_lines", "n_dropped")
    keys = frequent_keys(docs, min_docs, min_points).checkpoint()
    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_lines long, n_dropped long"])

    def rewrite(b, frequent_of):
        kept, n_lines, n_dropped = [], [], []
        ids = b.column(b.schema.get_field_index("doc_id")).to_pylist()
        nulls = b.column(b.schema.get_field_index("text")).is_null().to_pylist()
        for i, (doc_id, t) in enumerate(zip(ids, texts(b))):
            frequent, here = frequent_of(i, doc_id)
            lines, n = split_lines(t, frequent, here)
            kept.append(None if nulls[i] else b"\n".join(lines))
            n_lines.append(n)
            n_dropped.append(n - len(lines))
        columns = [pa.array(kept, pa.binary()).cast(pa.string()) if x == "text" else b.column(b.schema.get_field_index(x)) for x in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    if keys.count() <= broadcast_keys:
        rows = {bytes(k): d for k, _, d in keys.toLocalIterator()}
        sent = spark.sparkContext.broadcast(rows)

        def by_broadcast(batches):
            frequent = sent.value
            for b in batches:
                yield rewrite(b, (lambda i, d: (frequent, _FirstIn(frequent, d))) if keep_first else (lambda i, d: (frequent, ())))

        return map_batches(docs, by_broadcast, schema)

    def held(batches):
        for b in batches:
            out = [(d, hashlib.sha256(k).digest()) for d, t in zip(b.column(0).to_pylist(), texts(b)) for k in document_keys(t, min_points)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["doc_id", "key"])

    has = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), held, "doc_id long, key binary")
    # the filter leaves few of the documents' lines; AQE splits the joins' hot keys
    has = has.join(keys, "key").select("doc_id", F.struct("key", "first_doc").alias("k")).groupBy("doc_id").agg(F.collect_set("k").alias("_frequent"))
    document, frequent = unused(names, "doc", "frequent")
    has = has.withColumnsRenamed({"doc_id": document, "_frequent": frequent})
    joined = docs.join(has, F.col("doc_id").cast("long").eqNullSafe(F.col(document)), "left").drop(document)

    def by_join(batches):
        for b in batches:
            sets = [{bytes(x["key"]): x["first_doc"] for x in k or ()} for k in b.column(b.schema.get_field_index(frequent)).to_pylist()]
            yield rewrite(b, (lambda i, d: (sets[i], _FirstIn(sets[i], d))) if keep_first else (lambda i, d: (sets[i], ())))

    return map_batches(joined, by_join, schema)


class _FirstIn:
    """The frequent keys that a document is the first to hold."""

    def __init__(self, frequent: dict, doc_id):
        self.frequent, self.doc_id = frequent, doc_id

    def __contains__(self, digest) -> bool:
        return self.doc_id is not None and self.frequent.get(digest) == self.doc_id


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast(T.BinaryType()), 256).alias("kept_sha256"))
