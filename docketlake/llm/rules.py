"""Quality rules: plain measures, and a hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Byte n-grams of all documents are counted into a fixed number of buckets, once for the raw corpus and once for the
trusted target; both counts cover every document. A document's ratio is the mean over its n-grams of
log p(target) - log p(raw). The threshold is the ratio below which a fixed share of the trusted documents lies,
read from an exact histogram, so that equal inputs give equal verdicts. Half of the trusted documents (by a hash of
doc_id) are counted, the other half set the threshold, as texts that were counted look better than new ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.llm.common import held_out, map_batches, shared_folder, table, texts, with_label
from docketlake.llm.measures import base_measures, gram_groups, mean_weights

ORDER, BITS, SMOOTHING = 4, 16, 0.5
#: Share of trusted documents that the threshold may lose, and the histogram's step.
LOST_SHARE, STEP = 0.001, 1e-3


def gram_counts(marked: DataFrame, order: int = ORDER, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over rows with ``trusted`` true, and over all rows. At most 2 ** bits rows leave a task."""

    def count(batches):
        found = np.zeros((2, 1 << bits), np.int64)
        for b in batches:
            trusted = np.array(b.column(b.schema.get_field_index("trusted")).to_pylist(), bool)
            for first, starts, sizes, buckets, inside in gram_groups(texts(b), order, bits):
                found[1] += np.bincount(buckets[inside], minlength=1 << bits)
                target = np.repeat(trusted[first : first + len(sizes)], sizes)
                found[0] += np.bincount(buckets[inside][target], minlength=1 << bits)
        at = np.flatnonzero(found[1])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[0][at]), pa.array(found[1][at])], names=["bucket", "target", "raw"])

    rows = map_batches(marked.select("text", "trusted"), count, "bucket int, target long, raw long")
    out = np.zeros((2, 1 << bits), np.int64)
    for bucket, target, raw in rows.groupBy("bucket").agg(F.sum("target"), F.sum("raw")).collect():
        out[:, bucket] = target, raw
    return out[0], out[1]


def log_ratio(target: np.ndarray, raw: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p(target) - log p(raw) of each bucket."""
    def logs(x):
        return np.log(x + smoothing) - np.log(x.sum() + smoothing * len(x))

    return (logs(target) - logs(raw)).astype(np.float32)


def quality_rules(docs: DataFrame, trusted: DataFrame, lost_share: float = LOST_SHARE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.

    trusted: (doc_id) of the trusted target. A null or empty text has no words and fails the base rules. Without
    trusted documents the ratio is no judge and the base rules decide. Other columns are not read; a doc_id that
    repeats is judged row by row."""
    shared_folder(docs.sparkSession)
    marked = with_label(docs, trusted.select("doc_id", F.lit(1).alias("_trusted")), "_trusted").select("doc_id", "text", F.col("_trusted").isNotNull().alias("trusted"), (F.xxhash64("doc_id") % 2 == 0).alias("counted"))
    target, raw = gram_counts(marked.select("text", (F.col("trusted") & F.col("counted")).alias("trusted")))
    weights = log_ratio(target, raw)

    def measure(batches):
        for b in batches:
            found = texts(b)
            base = np.array([base_measures(t) for t in found], np.int64).reshape(-1, 5)
            llr = np.round(mean_weights(found, weights, ORDER, BITS), 9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(base[:, k]) for k in range(5)), pa.array(llr)], names=["doc_id", "trusted", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"])

    rows = map_batches(marked.select("doc_id", "text", (F.col("trusted") & ~F.col("counted")).alias("trusted")), measure, "doc_id long, trusted boolean, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).checkpoint()
    steps = rows.where("trusted and not base_failed").groupBy(F.floor(F.col("llr") / STEP).cast("long").alias("step")).count().collect()
    threshold = threshold_of({s: n for s, n in steps}, lost_share)
    kept = ~F.col("base_failed") & (F.floor(F.col("llr") / STEP) >= threshold)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "llr")


def threshold_of(steps: dict[int, int], lost_share: float) -> int:
    """The smallest step that loses at most the share of the counted documents."""
    allowed, lost = lost_share * sum(steps.values()), 0
    for s in sorted(steps):
        if lost + steps[s] > allowed:
            return s
        lost += steps[s]
    return -(1 << 62)


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where((F.col("quality") == 1) & ~held_out())
    return quality_rules(table(spark, sf_dir, "documents"), trusted)
