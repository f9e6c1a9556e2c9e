"""Phrase collocation mining by hierarchical pair naming.

Texts become blocks: each word of a block is a number in the block's own vocabulary, and -1 stands between pieces. A
block sends each distinct word once, with its count. Words that are frequent in their language get a name, which is
joined to the blocks that hold them; there, each position with a named word gives way to the pair of neighbouring
names, numbered anew within the block. Pairs of named words that are frequent are named in turn, then pairs of these,
so that the name of k words is a pair of names of k - 1 words (the first ones and the last ones), and nothing else is
counted. A name is the place of its word or pair among the level's frequent ones in order, so that a table of names is
just their sorted keys, eight bytes each. Up to ``BROADCAST_NAMES`` names of a level go to the blocks by broadcast, and
are looked up there; more are joined by a shuffle of the blocks' vocabularies, whose names then meet the blocks in
sorted order, one at a time.

The two names are the parent pointers: a phrase's first and last words of any number, and thus the counts for its cuts,
come down these pointers, and so does what lies inside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketlake.llm.common import map_batches, table, texts, unused, written

#: Words of a block (and one text more); longest phrase; rare phrases; a longer phrase has so many hundredths.
BLOCK_WORDS, LONGEST, LEAST, SUBSUMES = 300_000, 4, 30, 80
FACTOR, TOP = 2_000_000, 2000
#: Names of a level that a broadcast may carry: 8 bytes each, or a word.
BROADCAST_NAMES = 6_000_000
#: Rows that a worker is handed at a time: documents, and blocks, which are 2 to 3 MB each.
HANDED_DOCUMENTS, HANDED_BLOCKS = 1000, 4
#: Rows that a block sends at a time.
SENT = 100_000
#: The best phrases are found within so many deals of a language first.
DEALS = 64
NO_LANGUAGE = "und"
#: A-Z lower-cased, what ends a piece as a line end, tabs as spaces.
_FORM = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Block(dict):
    """Numbers of the words met, and the texts as numbers."""

    def __init__(self):
        super().__init__({b"\n": -1})
        self.codes: list[np.ndarray] = []
        self.size = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 1
        return number

    def add(self, text: bytes) -> None:
        tokens = [x for x in text.translate(_FORM).replace(b"\n", b" \n ").split(b" ") if x]
        codes = np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))
        self.codes += [codes, np.array([-1], np.int32)]
        self.size += len(codes)

    def batch(self, lang: str) -> pa.RecordBatch:
        codes = np.concatenate(self.codes)
        counts = np.bincount(codes[codes >= 0], minlength=len(self) - 1)
        words = pa.array([w for w in self if w != b"\n"], pa.binary()).cast(pa.string())
        return _row([pa.array([lang]), pa.array([int(counts.sum())]), pa.array([codes.tobytes()], pa.binary()), _list(words), _list(pa.array(counts.astype(np.int32)))], ["lang", "total", "codes", "words", "n"])


def _list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _row(columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=names)


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of texts of one language each: block, lang, total, codes (int32), words, n (counts)."""

    def cut(batches):
        held: dict[str, Block] = {}
        for part in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            for lang, text in zip(part.column(part.schema.get_field_index("lang")).to_pylist(), texts(part)):
                if lang not in held:
                    held[lang] = Block()
                held[lang].add(text)
                if sum(x.size for x in held.values()) >= BLOCK_WORDS:
                    largest = max(held, key=lambda k: held[k].size)
                    yield held.pop(largest).batch(largest)
        for lang, block in held.items():
            yield block.batch(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col("text").cast("string").alias("text"))
    with handed(docs.sparkSession, HANDED_DOCUMENTS):
        return written(map_batches(rows, cut, "lang string, total bigint, codes binary, words array<string>, n array<int>").withColumn("block", F.monotonically_increasing_id()), "phrases", HANDED_BLOCKS)


@contextmanager
def handed(spark: SparkSession, rows: int):
    """Meanwhile files are read, and workers handed, so many rows at a time at most: a batch lies in the JVM, as read and
    as sent, and in the worker at once."""
    before = {key: spark.conf.get(key) for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")}
    for key, most in before.items():
        spark.conf.set(key, str(rows if int(most) <= 0 else min(rows, int(most))))
    try:
        yield
    finally:
        for key, most in before.items():
            spark.conf.set(key, most)


def in_order(sums: DataFrame) -> DataFrame:
    """``sums`` (keys, f) with ``id``, each row's place (from 0) in the order of the keys.

    The sums are made of what was shuffled twice, for the sample of the order and for the order itself. They come in many
    tasks and are few rows: written first, each task's file had its own cost, on local disks forks of the executor, which
    count as its memory twice."""
    with handed(sums.sparkSession, HANDED_BLOCKS):
        rows = written(sums.orderBy(*[c for c in sums.columns if c != "f"]).withColumn("id", F.monotonically_increasing_id()), "phrases")
    task = F.shiftright("id", 33).cast("int")
    counts = {r["task"]: r["count"] for r in rows.groupBy(task.alias("task")).count().collect()}
    before = np.cumsum([0, *(counts.get(k, 0) for k in range(max(counts, default=0)))]).tolist()  # rows of the tasks before
    return rows.withColumn("id", F.get(F.lit(before), task) + F.col("id").bitwiseAND((1 << 33) - 1))


class Words:
    """Names of words by language, for blocks."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("id")
        self.known: dict[str, tuple[pa.Array, np.ndarray]] = {}
        for lang in pc.unique(rows["lang"]).to_pylist():
            own = rows.filter(pc.equal(rows["lang"], lang))
            self.known[lang] = own["words"].combine_chunks(), own["id"].to_numpy()

    def ids(self, lang: str, words: pa.Array) -> np.ndarray:
        """The words' names, -1 without. The known words are looked up among the block's, which are fewer."""
        out = np.full(len(words), -1, np.int64)
        known, ids = self.known.get(lang, (pa.array([], pa.string()), np.zeros(0, np.int64)))
        at = pc.fill_null(pc.index_in(known, value_set=words.cast(known.type)), -1).to_numpy()
        out[at[at >= 0]] = ids[at >= 0]
        return out


class Pairs:
    """Names of pairs of names, for blocks: places among the sorted keys of the pairs, a key being left * width + right
    where ``width`` is the number of names that pairs are made of."""

    def __init__(self, keys: np.ndarray, width: int):
        self.keys, self.width = np.sort(keys), width

    def ids(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), -1, np.int64)
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


def paired(codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions as numbers of pairs of neighbouring names (-1 where not both have one), the pairs' names, their counts."""
    known = (codes >= 0) & (np.append(ids, -1)[codes] >= 0)
    both = np.flatnonzero(known[:-1] & known[1:])
    pairs, numbers, n = np.unique(codes[both].astype(np.int64) << 32 | codes[both + 1], return_inverse=True, return_counts=True)
    out = np.full(len(codes), -1, np.int32)
    out[both] = numbers
    kept = out >= 0
    kept[1:] |= kept[:-1]  # of positions without a pair, one after each run with pairs
    return out[kept], ids[pairs >> 32], ids[pairs & 0xFFFFFFFF], n


class Level:
    """Blocks of one level: stored ``base`` blocks (of words or of pairs of names) and the names that lead on from them,
    each level's in a broadcast; ``width`` is the number of names that the level's pairs are made of."""

    def __init__(self, base: DataFrame, chain: list | None = None, width: int = 0):
        self.base, self.chain, self.width = base, chain or [], width
        self.of_words = "words" in base.columns

    def blocks(self):
        """What gives a task, for each of its base rows: block, codes, left and right names and counts of the pairs."""
        of_words, chain = self.of_words, self.chain

        def each(batches):
            for b in batches:
                column = lambda c: b.column(b.schema.get_field_index(c))
                for i in range(len(b)):
                    codes = np.frombuffer(column("codes")[i].as_py(), np.int32)
                    if of_words:
                        codes, left, right, n = paired(codes, chain[0].value.ids(column("lang")[i].as_py(), column("words")[i].values))
                    else:
                        left, right, n = (column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("left", "right", "n"))
                    for names in chain[of_words:]:
                        codes, left, right, n = paired(codes, names.value.ids(left, right))
                    yield column("block")[i].as_py(), codes, left, right, n

        return each

    def entries(self) -> DataFrame:
        """The blocks' distinct words (lang, words) or pairs (left, right), with their counts n."""
        if self.of_words and not self.chain:
            return self.base.select("lang", F.explode(F.arrays_zip("words", "n")).alias("e")).select("lang", "e.words", "e.n")
        each = self.blocks()

        def send(batches):
            for _, _, left, right, n in each(batches):
                for at in range(0, len(n), SENT):
                    yield _row([pa.array(left[at : at + SENT]), pa.array(right[at : at + SENT]), pa.array(n[at : at + SENT].astype(np.int64))], ["left", "right", "n"])

        return map_batches(self.base, send, "left bigint, right bigint, n bigint")

    def named(self, least: int) -> DataFrame:
        """Names of what is frequent: id, the keys, f."""
        rows = self.entries()
        return in_order(rows.groupBy(*[c for c in rows.columns if c != "n"]).agg(F.sum("n").alias("f")).where(F.col("f") >= least))

    def next(self, names: DataFrame) -> Level:
        """The blocks of pairs of these names."""
        n = names.count()
        if n > BROADCAST_NAMES:
            return Level(joined_names(self.stored(), names), width=n)
        if self.of_words and not self.chain:
            known = Words(names.select("lang", "words", "id").toArrow())
        else:
            key = F.col("left") * F.lit(self.width).cast("bigint") + F.col("right")
            known = Pairs(names.select(key.alias("key")).toArrow()["key"].to_numpy(), self.width)
        return Level(self.base, [*self.chain, names.sparkSession.sparkContext.broadcast(known)], n)

    def stored(self) -> DataFrame:
        """The blocks with all their names applied."""
        if not self.chain:
            return self.base
        each = self.blocks()

        def whole(batches):
            for block, codes, left, right, n in each(batches):
                yield _row([pa.array([block]), pa.array([codes.tobytes()], pa.binary()), _list(pa.array(left)), _list(pa.array(right)), _list(pa.array(n.astype(np.int32)))], ["block", "codes", "left", "right", "n"])

        with handed(self.base.sparkSession, HANDED_BLOCKS):
            return written(map_batches(self.base, whole, "block bigint, codes binary, left array<bigint>, right array<bigint>, n array<int>"), "phrases", HANDED_BLOCKS)


def by_block(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows sorted by block, codes first: each block, its codes, and the id of each number in it (-1 without)."""
    block, codes, parts = None, None, []

    def whole():
        local, ids = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
        out = np.full(max(int(codes.max(initial=-1)), int(local.max(initial=-1))) + 1, -1, np.int64)
        out[local] = ids
        return int(block), codes, out

    for b in batches:
        at, local, ids = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("block", "local", "id"))
        texts_of = b.column(b.schema.get_field_index("codes"))
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if at[lo] != block:
                if codes is not None:
                    yield whole()
                block, codes, parts = at[lo], None, []
            if local[lo] < 0:
                codes = np.frombuffer(texts_of[lo].as_py(), np.int32)
                lo += 1
            parts.append((local[lo:hi], ids[lo:hi]))
    if codes is not None:
        yield whole()


def joined_names(held: DataFrame, names: DataFrame) -> DataFrame:
    """Blocks of pairs of names, where names are too many for a task: block, codes, left, right, n."""
    lists = ["words"] if "words" in held.columns else ["left", "right"]
    entry = held.select("block", *(["lang"] if lists == ["words"] else []), F.posexplode(F.arrays_zip(*lists, "n")).alias("local", "e"))
    entry = entry.select("block", "local", *(["lang"] if lists == ["words"] else []), *[F.col(f"e.{k}").alias(k) for k in lists])
    back = entry.join(names.hint("merge"), [c for c in entry.columns if c not in ("block", "local")]).select("block", "local", "id")
    rows = held.select("block", F.lit(-1).alias("local"), F.lit(-1).cast("bigint").alias("id"), "codes").unionByName(back, allowMissingColumns=True)

    def pair(batches):
        for block, codes, ids in by_block(batches):
            new, left, right, n = paired(codes, ids)
            if len(n):
                yield _row([pa.array([block]), pa.array([new.tobytes()], pa.binary()), _list(pa.array(left)), _list(pa.array(right)), _list(pa.array(n.astype(np.int32)))], ["block", "codes", "left", "right", "n"])

    rows = rows.repartition("block").sortWithinPartitions("block", "local")
    return written(map_batches(rows, pair, "block bigint, codes binary, left array<bigint>, right array<bigint>, n array<int>"), "phrases", HANDED_BLOCKS)


def number(x: Column) -> Column:
    """Exact where 64 bits may not do."""
    return x.cast("decimal(19,0)")


def grown(names: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases one word longer: id, lang, phrase, last word, counts of their first and last words (by number), a, the
    names inside (``left``, ``right``), and names two words shorter inside (``inner``)."""
    first, last = shorter.alias("l"), shorter.alias("r")
    rows = names.alias("x").join(first, F.col("x.left") == F.col("l.id")).join(last, F.col("x.right") == F.col("r.id"))
    whole = lambda side: F.concat(F.col(f"{side}.{'heads' if side == 'l' else 'tails'}"), F.array("x.f"))
    return written(rows.select("x.id", "l.lang", F.concat_ws(" ", "l.phrase", "r.last").alias("phrase"), "r.last", whole("l").alias("heads"), whole("r").alias("tails"), F.col("x.f").alias("a"), "x.left", "x.right", F.array("l.left", "l.right", "r.right").alias("inner")), "phrases")


def scored(phrases: DataFrame, words: int) -> DataFrame:
    """lang, phrase, a, and l, r and score of the lowest cut."""
    a = F.col("a")

    def cut(k: int) -> Column:
        le, ri = F.get("heads", F.lit(k - 1)), F.get("tails", F.lit(words - k - 1))
        score = F.call_function("div", number(a) * F.lit(FACTOR).cast("decimal(7,0)"), number(le) + number(ri))
        return F.struct(score.cast("bigint").alias("score"), F.lit(k).alias("k"), le.alias("l"), ri.alias("r"))

    best = F.array_min(F.array(*(cut(k) for k in range(1, words))))
    return phrases.withColumn("best", best).select("id", "lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int | None = TOP) -> DataFrame:
    """The best phrases of 2 to 4 words of each language of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score.

    A null language counts as ``und``, a null text as empty; other columns are not read, repeated rows count each.
    Ties go by count, then by the phrase's bytes. ``top`` None gives all. No texts: no rows."""
    level = Level(blocks(docs))
    totals = level.base.groupBy("lang").agg(F.sum("total").alias("n"))
    names = level.named(least)
    none = F.lit(None).cast("bigint")
    phrases = names.select("id", "lang", F.col("words").alias("phrase"), F.col("words").alias("last"), F.array("f").alias("heads"), F.array("f").alias("tails"), F.col("f").alias("a"), none.alias("left"), none.alias("right"))
    levels = {}
    for k in range(2, LONGEST + 1):
        level = level.next(names)
        names = level.named(least)
        phrases = levels[k] = grown(names, phrases)
    inside = {k: [] for k in levels}  # names of k words with the count of a longer phrase
    for k in range(3, LONGEST + 1):
        inside[k - 1].append(levels[k].select(F.explode(F.array("left", "right")).alias("of"), "a"))
        if k > 3:
            inside[k - 2].append(levels[k].select(F.explode("inner").alias("of"), "a"))
    kept = []
    for k, rows in levels.items():
        out = scored(rows, k)
        for i, longer in enumerate(inside[k]):
            most = longer.groupBy("of").agg(F.max("a").alias("most"))
            out = out.join(most, F.col("id") == F.col("of"), "left").where(F.col("most").isNull() | (number(F.col("most")) * 100 < number(F.col("a")) * SUBSUMES)).drop("of", "most")
        kept.append(out.drop("id"))
    every = kept[0]
    for rows in kept[1:]:
        every = every.unionByName(rows)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        deal = unused(every.columns, "deal")[0]
        every = every.withColumn(deal, F.pmod(F.xxhash64("phrase"), F.lit(DEALS)))
        every = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang", deal).orderBy(*order))).where(F.col("rank") <= top).drop(deal)
    every = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    if top is not None:
        every = every.where(F.col("rank") <= top)
    return every.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
