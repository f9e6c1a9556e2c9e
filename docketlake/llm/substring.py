"""Substring dedup: word windows that occur twice, found with compressed FM-indexes per shard.

1. Every window of ``window`` words has an anchor: of its ``ANCHOR``-word sequences that of least hash. Equal windows
   have equal anchors, so a twice-seen filter over these (see ``lines``) leaves the windows that may repeat; nothing
   else leaves the map. Words are hashed and windows anchored as arrays, many documents at a time.
2. Runs of such windows with the same anchor are segments. One pass writes each segment once per stretch of a task,
   with its count, and the place of each run: a passage that a third of the documents share is a row per task.
   Segments go to shards by their anchor; hot anchors are split by that of greatest hash.
3. A shard's segments that occur twice are repeated from end to end. For the others it builds an FM-index (wavelet
   matrix over the word numbers, bit-packed, with popcount ranks) over its distinct segments and streams them through
   backward search: matching statistics from the right, in lockstep over the segments, with at least two occurrences.
   Intervals of ``window`` words and more are reported. So the index decides every window of a segment that no other
   place has whole.
4. A shard key of over ``SHARD_WORDS`` words isn't indexed in one place: its windows are counted by digest over all
   tasks (the ``HOT_KEYS`` largest keys; the rest then hold less than a ``HOT_KEYS``-th of all words each).
5. Reports join the places of their segments, the most frequent ones by broadcast, and then the documents, which drop
   the covered words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.llm.common import chunks, map_batches, shared_folder, ship_package, table, texts, unused, written
from docketlake.llm.lines import MAX_BITS, MIN_BITS, SeenFilters, positions, twice_seen

WINDOW, ANCHOR = 35, 16
BITS_PER_DOC, SHARD_WORDS, TASK_BYTES = 1024, 400_000, 64_000_000
#: Shard keys that are counted by windows, and segments whose places are met by broadcast, at most; a segment found
#: in fewer places than ``HOT_PLACES`` is dealt by its digest.
HOT_KEYS, HOT_SEGMENTS, HOT_PLACES = 100_000, 100_000, 256
CHUNK = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A number for each byte at each place in a word; bytes from ``_LONG`` on share the last place's.
_LONG = 32
_TABLE = np.random.default_rng(42).integers(1, 1 << 63, (256, _LONG), np.uint64, endpoint=True)
_TABLE[[32, 10]] = 0  # what stands between words
_TABLE = _TABLE.ravel()


def slide(x: np.ndarray, n: int, take) -> np.ndarray:
    """``take`` (minimum or maximum) over each ``n`` neighbours, by doubling."""
    size, held = 1, x
    while size * 2 <= n:
        held = take(held[: len(held) - size], held[size:])
        size *= 2
    return take(held[: len(held) - (n - size)], held[n - size :]) if n > size else held


class Windows:
    """The windows of some texts, as arrays. Texts of fewer words have none and are left out.

    ``blob``: the texts, words joined by one space, each text ended by a line feed. ``starts`` and ``ends`` are of its
    words, ``first`` is each text's first word, ``of`` the text's number among those given."""

    def __init__(self, found: list[bytes], window: int):
        whole = [(i, b" ".join(w)) for i, w in ((i, t.split()) for i, t in enumerate(found)) if len(w) >= window]
        self.window, self.size = window, min(ANCHOR, window)
        self.span = window - self.size + 1
        self.of = [i for i, _ in whole]
        self.blob = b"\n".join([*(x for _, x in whole), b""])
        data = np.frombuffer(self.blob, np.uint8)
        self.ends = np.flatnonzero((data == 32) | (data == 10))
        self.starts = np.r_[0, self.ends[:-1] + 1] if len(self.ends) else self.ends
        stops = np.flatnonzero(data[self.ends] == 10) + 1
        self.first = np.r_[0, stops[:-1]] if len(stops) else stops
        place = np.arange(len(data), dtype=np.int32) - np.repeat(self.starts, self.ends + 1 - self.starts).astype(np.int32)
        np.minimum(place, _LONG - 1, out=place)
        place += data.astype(np.int32) * _LONG
        self.words = np.add.reduceat(_TABLE[place], self.starts) if len(data) else np.zeros(0, np.uint64)
        self.n = len(self.words) - window + 1 if len(data) else 0
        self.inside = np.ones(max(self.n, 0), bool)  # windows that lie in one text
        for stop in stops[:-1].tolist():
            self.inside[max(0, stop - window + 1) : stop] = False

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the anchor sequences, and the least of each window (0 for a window that isn't inside)."""
        if self.n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        n = len(self.words) - self.size + 1
        grams = np.zeros(n, np.uint64)
        for k in range(self.size):
            grams *= _BASE
            grams += self.words[k : k + n]
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        grams ^= grams >> np.uint64(32)
        return grams, np.where(self.inside, slide(grams, self.span, np.minimum), np.uint64(0))

    def segment(self, first: int, n: int) -> bytes:
        """The words of ``n`` windows from window ``first`` on."""
        return self.blob[self.starts[first] : self.ends[first + n + self.window - 2]]


def least_anchors(found: list[bytes], window: int) -> np.ndarray:
    """The hash of each place that is the least anchor of some window, once per place."""
    w = Windows(found, window)
    grams, least = w.anchors()
    if not len(grams):
        return grams
    none = np.zeros(w.span - 1, np.uint64)
    return grams[slide(np.r_[none, least, none], w.span, np.maximum) == grams]


def suspect_runs(w: Windows, known: np.ndarray, bits: int, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and shard key of maximal runs that may repeat. Their windows share the least
    anchor, and the greatest one too where the least is hot."""
    grams, least = w.anchors()
    if not len(grams):
        return (np.zeros(0, np.int64),) * 3
    keys = least
    if len(often) and (hot := np.isin(least, often)).any():
        keys = np.where(hot, least ^ slide(grams, w.span, np.maximum) * _BASE, least)
    begins = np.r_[True, keys[1:] != keys[:-1]]
    begins[w.first[w.first < w.n]] = True
    begins[1:] |= w.inside[1:] != w.inside[:-1]
    at = np.flatnonzero(begins)
    sizes = np.diff(np.r_[at, w.n])
    on = w.inside[at]
    on[on] = SeenFilters.has(known, positions(least[at[on]], bits))
    return at[on], sizes[on], keys[at[on]].view(np.int64)


def depth(longest: int) -> int:
    """How deep an index for patterns of ``longest`` numbers is sorted at least, if they are below 2 ** 21."""
    size = 3
    while size < longest:
        size *= 2
    return size


def ranked(key: np.ndarray) -> np.ndarray:
    """Dense ranks."""
    order = np.argsort(key, kind="stable")
    held = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.r_[False, held[1:] != held[:-1]])
    return rank


class Bits:
    """Packed bits with ranks by popcount."""

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + bytes(16 - len(packed) % 8), np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)].astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        word, shift = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << shift) - np.uint64(1)))


class FMIndex:
    """FM-index over a sequence of numbers that ends with 0, for patterns of up to ``depth(longest)`` of them."""

    def __init__(self, text: np.ndarray, longest: int):
        n = len(text)
        padded = np.r_[text, 0, 0].astype(np.uint64)
        # three numbers fit in one of 63 bits; then the ranks of neighbours double what is sorted
        if int(text.max()) < 1 << 21:
            key, size = padded[:-2] << np.uint64(42) | padded[1:-1] << np.uint64(21) | padded[2:], 3
        else:
            key, size = padded[:-2], 1
        rank = ranked(key)
        while size < longest:
            key = rank * (n + 1)
            key[: n - size] += rank[size:] + 1
            rank = ranked(key)
            size *= 2
        order = np.argsort(rank, kind="stable")
        last = text[order - 1]
        self.levels = max(1, int(text.max()).bit_length())
        self.begin = np.searchsorted(np.sort(text), np.arange(int(text.max()) + 2))
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):  # wavelet matrix
            flags = (last >> level & 1).astype(bool)
            self.bits.append(Bits(flags))
            self.zeros.append(int(n - flags.sum()))
            last = np.r_[last[~flags], last[flags]]
        self.n = n
        self.low = self._starts(int(text.max()) + 1)

    def _starts(self, n_symbols: int) -> np.ndarray:
        return self._descend(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bits, zeros, level in zip(self.bits, self.zeros, range(self.levels - 1, -1, -1)):
            ones = bits.rank(i)
            i = np.where(c >> level & 1, zeros + ones, i - ones)
        return i

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``c`` put before them."""
        both = self._descend(np.r_[c, c], np.r_[lo, hi])
        base = self.begin[c] - self.low[c]
        return both[: len(c)] + base, both[len(c) :] + base


def repeated_windows(segments: list[list[bytes]], counts: list[int], window: int) -> list[list[tuple[int, int]]]:
    """For each of the distinct segments the intervals (first, end) of its windows that occur twice or more in all."""
    out: list[list[tuple[int, int]]] = [[(0, len(s) - window + 1)] if n > 1 else [] for s, n in zip(segments, counts)]
    asked = [i for i, n in enumerate(counts) if n == 1]
    if not asked:
        return out
    number: dict[bytes, int] = {}
    ids = [np.fromiter((number.setdefault(w, len(number) + 1) for w in s), np.int64, len(s)) for s in segments]
    stop = np.zeros(1, np.int64)
    longest = depth(window + 1)  # longer matches are cut and go on from their left end
    index = FMIndex(np.concatenate([x for s in ids for x in (s, stop)]), longest)
    ids = [ids[i] for i in asked]
    flat, starts = np.concatenate(ids), np.r_[0, np.cumsum([len(s) for s in ids])]
    seg = np.arange(len(ids))
    first, end = starts[:-1].copy(), starts[1:].copy()  # words left of ``end`` are searched
    p, lo, hi = end.copy(), np.zeros(len(ids), np.int64), np.full(len(ids), index.n)
    while len(seg):
        can = p > first
        a, b = lo.copy(), hi.copy()
        a[can], b[can] = index.extend(flat[p[can] - 1], lo[can], hi[can])
        on = can & (b - a >= 2) & (end - p < longest)
        p[on] -= 1
        lo[on], hi[on] = a[on], b[on]
        off = np.flatnonzero(~on)
        if len(off):
            for i in off[end[off] - p[off] >= window].tolist():
                base = starts[seg[i]]
                out[asked[seg[i]]].append((int(p[i] - base), int(end[i] - window + 1 - base)))
            # the next window to decide is the last one that begins left of p
            end[off] = np.minimum(end[off] - 1, p[off] - 1 + window)
            p[off], lo[off], hi[off] = end[off], 0, index.n
            live = end - first >= window
            seg, first, end, p, lo, hi = (x[live] for x in (seg, first, end, p, lo, hi))
    return out


def repeats_inside(words: list[bytes], window: int) -> bool:
    """Whether a window of the segment occurs in it twice."""
    n = len(words) - window + 1
    return n > 1 and len({tuple(words[i : i + window]) for i in range(n)}) < n


def document_key(doc_id, text: bytes) -> bytes:
    """Tells rows apart by doc_id and text."""
    return xxhash.xxh3_128_digest(b"%d:" % doc_id + text) if doc_id is not None else xxhash.xxh3_128_digest(b":" + text)


def digest_of(segment: bytes) -> bytes:
    return xxhash.xxh3_128_digest(segment)


SUSPECTS = "document binary, at int, digest binary, shard long, words int, segment binary, n long"
FOUND = "digest binary, n long, firsts array<int>, ends array<int>"


def suspects(docs: DataFrame, window: int) -> DataFrame:
    """Places of suspected runs (document, at, digest), and segments (digest, shard, words, segment, n), in one table:
    a row that has no segment is a place."""
    bits = min(MAX_BITS, max(MIN_BITS, (docs.count() * BITS_PER_DOC).bit_length()))
    sent = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, bits, lambda g: least_anchors(g, window)))

    def run(batches) -> Iterator[pa.RecordBatch]:
        known, often = np.frombuffer(sent.value[0], np.uint8), sent.value[1]
        held: dict[bytes, list] = {}
        size = 0

        def batch(place, segment):
            return pa.RecordBatch.from_arrays(
                [pa.array([*place[0], *[None] * len(segment[0])], pa.binary()), pa.array([*place[1], *[None] * len(segment[0])], pa.int32()), pa.array([*place[2], *segment[0]], pa.binary()),
                 *(pa.array([*[None] * len(place[0]), *x], kind) for x, kind in zip(segment[1:], (pa.int64(), pa.int32(), pa.binary(), pa.int64())))],
                names=["document", "at", "digest", "shard", "words", "segment", "n"],
            )

        def flush():
            return batch([[], [], []], [list(held), *zip(*held.values())])

        for b in batches:
            ids, first = b.column(0).to_pylist(), 0
            for group in chunks(texts(b), CHUNK):
                w = Windows(group, window)
                at, sizes, keys = suspect_runs(w, known, bits, often)
                text_of = np.searchsorted(w.first, at, "right") - 1
                place: list[list] = [[], [], []]
                last = key = None
                for a, n, shard, i in zip(at.tolist(), sizes.tolist(), keys.tolist(), text_of.tolist()):
                    if i != last:
                        last, key, base = i, document_key(ids[first + w.of[i]], group[w.of[i]]), int(w.first[i])
                    segment = w.segment(a, n)
                    digest = digest_of(segment)
                    for to, x in zip(place, (key, a - base, digest)):
                        to.append(x)
                    if (known_one := held.get(digest)) is not None:
                        known_one[3] += 1
                    else:
                        held[digest] = [shard, n + window - 1, segment, 1]
                        size += len(segment)
                first += len(group)
                if place[0]:
                    yield batch(place, [[], [], [], [], []])
                if size >= TASK_BYTES:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    return map_batches(docs, run, SUSPECTS)


def found_batch(rows: list[tuple[bytes, int, list[tuple[int, int]]]]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    columns = [d for d, _, _ in rows], [n for _, n, _ in rows], [[a for a, _ in x] for *_, x in rows], [[e for _, e in x] for *_, x in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["digest", "n", "firsts", "ends"])


def indexed(segments: DataFrame, window: int) -> DataFrame:
    """Repeated intervals of windows of ``segments`` (digest, shard, segment, n), by an index per shard."""

    def search(batches):
        """Shard keys come in order, a key's equal segments one after the other; an index takes whole keys until it has
        enough words. A key of one segment needs none, but where a window may occur in the segment twice."""
        held: list[list] = []
        group: list[list] = []
        whole: list[tuple] = []
        size, last = 0, None

        def close():
            nonlocal size
            if len(group) == 1 and group[0][2] > 1:
                whole.append((group[0][0], group[0][2], [(0, group[0][1].count(b" ") + 2 - window)]))
            elif len(group) > 1 or group and repeats_inside(group[0][1].split(), window):
                held.extend(group)
                size += sum(s.count(b" ") + 2 for _, s, _ in group)
            group.clear()

        def report():
            nonlocal held, size, whole
            found = repeated_windows([s.split() for _, s, _ in held], [n for *_, n in held], window) if held else []
            rows = whole + [(d, n, x) for (d, _, n), x in zip(held, found) if x]
            held, size, whole = [], 0, []
            return found_batch(rows)

        for b in batches:
            for shard, digest, segment, n in zip(*(c.to_pylist() for c in b.columns)):
                if shard != last:
                    close()
                    if size >= SHARD_WORDS or len(whole) >= 10_000:
                        yield report()
                    last = shard
                if group and group[-1][0] == digest:
                    group[-1][2] += n
                else:
                    group.append([digest, segment, n])
        close()
        yield report()

    dealt = segments.select("shard", "digest", "segment", "n").repartition("shard").sortWithinPartitions("shard", "digest")
    return map_batches(dealt, search, FOUND)


def counted(segments: DataFrame, window: int) -> DataFrame:
    """As ``indexed``, for shard keys too large for one index: windows are counted by their digest."""

    def windows(batches):
        for b in batches:
            for digest, segment, n in zip(*(c.to_pylist() for c in b.columns)):
                words = segment.split()
                found = [digest_of(b" ".join(words[i : i + window])) for i in range(len(words) - window + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([digest] * len(found), pa.binary()), pa.array(range(len(found)), pa.int32()), pa.array([n] * len(found), pa.int64())], names=["window", "digest", "at", "n"])

    whole = segments.groupBy("digest").agg(F.first("segment").alias("segment"), F.sum("n").alias("n"))
    held = map_batches(whole.select("digest", "segment", "n"), windows, "window binary, digest binary, at int, n long")
    twice = held.groupBy("window").agg(F.sum("n").alias("times")).where("times > 1").select("window")
    firsts = held.join(twice, "window").groupBy("digest").agg(F.first("n").alias("n"), F.sort_array(F.collect_set("at")).alias("firsts"))
    return firsts.select("digest", "n", "firsts", F.transform("firsts", lambda x: x + 1).alias("ends"))


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(document, spans): for documents with repeated windows, by ``document_key``, the intervals of words covered."""
    shared_folder(docs.sparkSession)
    ship_package(docs.sparkSession)
    held = written(suspects(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window), "substring")
    places, segments = held.where("segment IS NULL").select("document", "at", "digest"), held.where("segment IS NOT NULL").select("digest", "shard", "segment", "n")
    sizes = held.where("shard IS NOT NULL").groupBy("shard").agg(F.sum("words").alias("words")).where(F.col("words") > SHARD_WORDS)
    large = written(sizes.orderBy(F.desc("words"), "shard").limit(HOT_KEYS).select("shard"), "substring")
    n_large = large.count()
    if n_large:
        few = F.broadcast(large)
        found = indexed(segments.join(few, "shard", "left_anti"), window).unionByName(counted(segments.join(few, "shard", "left_semi"), window))
    else:
        found = indexed(segments, window)
    found = written(found, "substring")
    # a digest has one row in found; the most frequent meet their places where these are
    hot = found.where(F.col("n") >= HOT_PLACES).orderBy(F.desc("n"), "digest").limit(HOT_SEGMENTS)
    few = F.broadcast(hot.select("digest"))
    met = places.join(F.broadcast(hot), "digest").unionByName(places.join(few, "digest", "left_anti").join(found.join(few, "digest", "left_anti"), "digest"))
    spans = met.select("document", F.zip_with("firsts", "ends", lambda a, e: F.struct((F.col("at") + a).alias("a"), (F.col("at") + e - 1 + window).alias("b"))).alias("s"))
    return spans.groupBy("document").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("spans"))


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text: the words, joined by one space, that no repeated window covers.

    A window is ``window`` consecutive words of one document; it is repeated if its word sequence starts anywhere
    else, in the same document or another. Null and empty texts have no words; texts of fewer words lose none;
    repeated rows are each other's repeats. Columns of the three names are replaced, others stay, whatever their
    names."""
    kept = docs.drop("n_words", "n_removed", "kept_text")
    names = kept.columns
    key, document, covered = unused(names, "key", "document", "covered")
    spans = repeated_spans(kept, window).withColumnsRenamed({"document": document, "spans": covered})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def mark(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([document_key(i, t) for i, t in zip(b.column(b.schema.get_field_index("doc_id")).to_pylist(), texts(b))], pa.binary())], names=[*names, key])

    marked = map_batches(kept, mark, f"{schema}, `{key}` binary")
    joined = marked.join(spans, F.col(key) == F.col(document), "left").drop(document, key)

    def cut(batches):
        for b in batches:
            n_words, n_removed, out = [], [], []
            for t, found in zip(texts(b), b.column(b.schema.get_field_index(covered)).to_pylist()):
                words = t.split()
                if found:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s in found:
                        edge[s["a"]] += 1
                        edge[s["b"]] -= 1
                    stays = np.cumsum(edge)[:-1] == 0
                    left = [words[i] for i in np.flatnonzero(stays)]
                else:
                    left = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                out.append(b" ".join(left))
            columns = [b.column(b.schema.get_field_index(x)) for x in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names=[*names, "n_words", "n_removed", "kept_text"])

    return map_batches(joined, cut, f"{schema}, n_words long, n_removed long, kept_text string")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
