"""Toxicity by class-conditional Kneser-Ney models over the bytes of words.

All n-grams of the labelled documents that may be learnt from are counted by class. An n-gram is a byte of a word
(the space after it included) with the up to ``ORDER - 1`` bytes before it in the word; as a number of 48 bits it
makes counting and smoothing plain aggregations and joins, whose tables grow with the corpus. Both classes back off
to one shared model: interpolated Kneser-Ney, whose lower orders count distinct continuations over both classes, so
that a rare expression gets much the same estimate on both sides. ``SHRINK`` pseudo-counts pull each class further
towards it.

A toxic text is ordinary text with some toxic words. So the toxic model is re-estimated ``ROUNDS`` times: a word of a
toxic document counts by the probability that it is a toxic one (``SHARE`` of them are, before the word is seen).
The toxic likelihood of a word then is ``1 - m`` parts ordinary and ``m`` parts toxic, for each m of ``MIXED``. The log
ratio of both likelihoods, divided by the number of words, is the evidence. Scoring looks up each n-gram's
log p(toxic) - log p(ordinary) by its exact number. An n-gram never met has in each class the back-off mass after its
context times the probability of the shared lower order, which is the same on both sides and so leaves the
difference: the ratio of the masses. The score is the probability that a logistic calibration gives, fitted on
labelled documents that were not counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.llm.common import held_out, map_batches, table, texts, with_label, written

ORDER, DISCOUNT = 7, 0.75
SHRINK, MIXED = 5.0, (0.001, 0.02)
#: Rounds of re-estimation, the share of toxic words that they begin with, and the fixed-point unit of counts.
ROUNDS, SHARE, UNIT = 1, 0.03, 1 << 16
#: Labelled documents that the calibration reads at most, by the order of a hash of doc_id.
CALIBRATED = 20_000
SPACES = bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")


def grams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as numbers, and the number of the word that each belongs to."""
    if not text.strip():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(b" " * (ORDER - 1) + text.lower().translate(SPACES) + b" ", np.uint8)
    n = len(data) - ORDER + 1
    space = data[ORDER - 1 :] == 32
    begins = np.r_[True, space[:-1]]
    at = np.arange(n, dtype=np.int32)
    back = at - np.maximum.accumulate(np.where(begins, at, 0))
    out = np.zeros(n, np.int64)
    for k in range(ORDER):
        out <<= 8
        out |= np.where(back >= ORDER - 1 - k, data[k : k + n], 32)
    word = ~(space & begins)
    return out[word], (np.cumsum(begins & word) - 1)[word]


def look_up(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values of ``keys`` in a table of sorted keys and values, 0 where there is none; and which are there."""
    held, values = table
    if not len(held):
        return np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
    met = held[at] == keys
    return np.where(met, values[at], np.float32(0)), met


def class_counts(marked: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """(g, tox, ord): how often each n-gram stands in toxic and in ordinary documents of ``marked`` (text, toxic), in
    ``UNIT``-ths. With a model, words of toxic documents count by their probability of being toxic ones."""

    def weights(text: bytes, word: np.ndarray) -> np.ndarray:
        if model is None:
            return np.full(len(word), UNIT, np.int64)
        odds = SHARE * np.exp(np.minimum(model.words(text), 30))
        return np.rint(odds / (odds + 1 - SHARE) * UNIT).astype(np.int64)[word]

    def count(batches):
        for b in batches:
            labels = b.column(1).to_pylist()
            for wanted, column in ((1, 0), (0, 1)):
                held: list[tuple[np.ndarray, np.ndarray]] = []
                n = 0
                chosen = [t for t, x in zip(texts(b), labels) if x == wanted]
                for i, t in enumerate(chosen):
                    g, word = grams(t)
                    held.append((g, weights(t, word) if wanted else np.full(len(g), UNIT, np.int64)))
                    n += len(g)
                    if n > 4_000_000 or i == len(chosen) - 1:
                        g, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
                        c, none = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
                        np.add.at(c, at, np.concatenate([x for _, x in held]))
                        yield pa.RecordBatch.from_arrays([pa.array(g), *(map(pa.array, (c, none) if column == 0 else (none, c)))], names=["g", "tox", "ord"])
                        held, n = [], 0

    rows = map_batches(marked.select("text", F.col("toxic").cast("int")), count, "g long, tox long, ord long")
    return rows.groupBy("g").agg(F.sum("tox").alias("tox"), F.sum("ord").alias("ord"))


#: Rows of a count table that make a partition.
PARTITION_ROWS = 500_000


def kept(c: str):
    """What the discount leaves of a count."""
    return F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))


def shared_model(counts: DataFrame, n_parts: int) -> tuple[DataFrame, list[DataFrame]]:
    """(g, p), and what to unpersist after use: interpolated Kneser-Ney over both classes. Orders below the highest count distinct left neighbours."""
    levels = {ORDER: counts.select("g", ((F.col("tox") + F.col("ord")) / UNIT).alias("c"))}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = levels[k + 1].groupBy(F.col("g").bitwiseAND((1 << 8 * k) - 1).alias("g")).agg(F.count("*").cast("double").alias("c")).coalesce(n_parts).persist()
    total = levels[1].agg(F.sum("c")).first()[0] or 1
    lower = levels[1].select("g", ((F.col("c") + 0.5) / F.lit(total + 128.0)).alias("p"))
    for k in range(2, ORDER + 1):
        level = levels[k].withColumn("h", F.shiftright("g", 8)).withColumn("rest", F.col("g").bitwiseAND((1 << 8 * (k - 1)) - 1))
        contexts = level.groupBy("h").agg(F.sum("c").alias("all"), (F.sum("c") - F.sum(kept("c"))).alias("left"))
        joined = level.join(contexts, "h").coalesce(n_parts).join(lower.withColumnRenamed("g", "rest").withColumnRenamed("p", "below"), "rest")
        lower = joined.select("g", ((kept("c") + F.col("left") * F.col("below")) / F.col("all")).alias("p")).coalesce(n_parts)
    return lower, [levels[k] for k in range(1, ORDER)]


class ToxicityModel:
    """The tables for scoring, of n-grams and of contexts (sorted keys, log ratios), and the calibration."""

    def __init__(self, ratios: tuple[np.ndarray, np.ndarray], backoff: tuple[np.ndarray, np.ndarray], calibration: np.ndarray | None = None):
        self.ratios, self.backoff, self.calibration = ratios, backoff, calibration

    def words(self, text: bytes) -> np.ndarray:
        """Each word's log p(toxic) - log p(ordinary)."""
        g, word = grams(text)
        if not len(g):
            return np.zeros(0)
        found, met = look_up(g, self.ratios)
        if len(new := np.flatnonzero(~met)):
            found[new] = look_up(g[new] >> 8, self.backoff)[0]
        return np.bincount(word, found)

    def evidence(self, text: bytes) -> tuple[list[float], int]:
        """Mean over the words of the log likelihood ratio for each mixture, and the number of words."""
        ratio = np.minimum(self.words(text), 20)
        if not len(ratio):
            return [0.0] * len(MIXED), 0
        return [float(np.log1p(m * np.expm1(ratio)).mean()) for m in MIXED], len(ratio)

    def inputs(self, found: list[bytes]) -> np.ndarray:
        """What the calibration sees: for each mixture the mean and the size of the sum, and the number of words."""
        met = [self.evidence(t) for t in found]
        mean, n = np.array([x for x, _ in met], float).reshape(-1, len(MIXED)), np.array([k for _, k in met], float)[:, None]
        return np.concatenate([np.ones_like(n), 10 * mean, np.sign(mean) * np.log1p(np.abs(mean * n)), np.log1p(n) / 10], 1)

    def score(self, found: list[bytes]) -> np.ndarray:
        x = self.inputs(found)
        s = 1 / (1 + np.exp(-np.clip(x @ self.calibration, -40, 40)))
        return np.where(x[:, -1] > 0, np.round(s, 9), 0.0)


def with_shared(counts: DataFrame) -> DataFrame:
    """``counts`` with each n-gram's probability in the shared model: g, tox, ord, p; on disk."""
    n_parts = counts.count() // PARTITION_ROWS + 1
    shared, held = shared_model(counts.coalesce(n_parts), n_parts)
    out = written(counts.coalesce(n_parts).join(shared, "g").coalesce(n_parts), "toxicity")
    for level in held:
        level.unpersist()
    return out


def ratio_tables(counts: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """From (g, tox, ord, p), log p(toxic) - log p(ordinary) of each n-gram met, and of the back-off masses of each
    context: sorted keys and values. All of both reach the driver, 12 bytes a row."""
    units = counts.select("g", F.shiftright("g", 8).alias("h"), (F.col("tox") / UNIT).alias("tox"), (F.col("ord") / UNIT).alias("ord"), "p")
    contexts = units.groupBy("h").agg(
        F.sum("tox").alias("ct"), F.sum("ord").alias("co"), (F.sum("tox") - F.sum(kept("tox"))).alias("lt"), (F.sum("ord") - F.sum(kept("ord"))).alias("lo")).persist()

    def chance(c, left, total):
        return (kept(c) + (F.col(left) + SHRINK) * F.col("p")) / (F.col(total) + SHRINK)

    seen = units.join(contexts, "h").select("g", F.log(chance("tox", "lt", "ct") / chance("ord", "lo", "co")).cast("float").alias("r"))

    def mass(left, total):
        return (F.col(left) + SHRINK) / (F.col(total) + SHRINK)

    left = contexts.select(F.col("h").alias("g"), F.log(mass("lt", "ct") / mass("lo", "co")).cast("float").alias("r"))

    def sorted_table(rows):
        found = rows.toArrow()
        keys, values = found["g"].to_numpy(), np.round(found["r"].to_numpy(), 4).astype(np.float32)
        order = np.argsort(keys)
        return keys[order], values[order]

    out = sorted_table(seen), sorted_table(left)
    contexts.unpersist()
    return out


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's steps, with a small ridge."""
    w = np.zeros(x.shape[1])
    ridge = 0.1 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, calibrated: int = CALIBRATED) -> ToxicityModel:
    """Fit on ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic 0/1). Three quarters of the labelled documents,
    by a hash of doc_id, are counted, all of them; the calibration reads at most ``calibrated`` of the others."""
    labels = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(4)) == 0
    marked = with_label(docs, labels.where(~part), "toxic").where(F.col("toxic").isNotNull())
    # the shared model stays that of all counts; rounds change what toxic documents add to their class
    counts = with_shared(written(class_counts(marked), "toxicity"))
    model = ToxicityModel(*ratio_tables(counts))
    for _ in range(ROUNDS):
        toxic = class_counts(marked.where("toxic = 1"), model).select("g", "tox")
        model = ToxicityModel(*ratio_tables(counts.drop("tox").join(toxic, "g", "left").fillna(0, ["tox"])))
    chosen = labels.where(part).groupBy("doc_id").agg(F.min("toxic").alias("toxic")).orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id").limit(calibrated)

    def inputs(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in model.inputs(texts(b))], pa.binary())], names=["doc_id", "toxic", "x"])

    rest = with_label(docs, chosen, "toxic").where(F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int"), "text")
    # one row for each of the chosen ids, however many rows repeat it
    rows = map_batches(rest, inputs, "doc_id long, toxic int, x binary").groupBy("doc_id").agg(F.min(F.struct("toxic", "x")).alias("r")).select("r.*").orderBy("toxic", "x").collect()
    x = np.array([np.frombuffer(r[1]) for r in rows]).reshape(-1, 2 + 2 * len(MIXED))
    model.calibration = calibrate(x, np.array([r[0] for r in rows], float))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, to: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1. Null and empty texts, and texts of white space, score 0; a column named as
    ``to`` is replaced; rows with equal texts score alike."""
    kept = docs.drop(to)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{to}` double"])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(texts(b)), pa.float64())], names=[*b.schema.names, to])

    return map_batches(kept, run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic"))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
