"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are compared by the non-negative risk of Kiryo et al. (2017):
prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)) with the logistic loss. The class prior is estimated from a
first classifier of positives against unlabelled text: the least ratio of the shares that lie above a cut, with a
margin for chance (as Garg et al., 2021). Features: the text's format (``SHAPE``) and the shares of hashed byte
n-grams, so that scoring is one pass without shuffle.

Fitted on at most ``POSITIVES`` trusted documents and ``UNLABELLED`` others, taken by the order of a hash of doc_id;
every document is scored over its whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.llm.common import held_out, map_batches, table, texts
from docketlake.llm.measures import SHAPE, gram_groups, mean_weights, shape

POSITIVES, UNLABELLED = 4_000, 8_000
ORDER, BITS = 3, 7
ROUNDS, RATE, DECAY = 300, 0.03, 1e-2


def features(found: list[bytes]) -> np.ndarray:
    """One row for each text: its shape, then the shares of the buckets."""
    out = np.zeros((len(found), len(SHAPE) + (1 << BITS)), np.float32)
    for i, t in enumerate(found):
        out[i, : len(SHAPE)] = shape(t)
    for first, starts, sizes, buckets, _ in gram_groups(found, ORDER, BITS):
        for i, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
            out[first + i, len(SHAPE) :] = np.bincount(buckets[a : a + n], minlength=1 << BITS) / max(1, n)
    return out


def sample_features(docs: DataFrame, positives: DataFrame, n_positive: int, n_other: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of trusted and of unlabelled documents, at most as many as said."""
    order = (F.xxhash64(F.col("doc_id")), "doc_id")
    chosen = positives.select(F.col("doc_id").cast("long")).distinct().orderBy(*order).limit(n_positive).select("doc_id", F.lit(1).alias("kind"))
    others = docs.select(F.col("doc_id").cast("long")).where(F.col("doc_id").isNotNull() & ~held_out()).distinct().orderBy(*order).limit(n_other)
    chosen = chosen.unionByName(others.select("doc_id", F.lit(0).alias("kind")))

    def make(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in features(texts(b)).astype(np.float16)], pa.binary())], names=["doc_id", "kind", "row"])

    # at most n_positive + n_other ids are broadcast; each gives one row, however many rows repeat it
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "kind", "text")
    rows = map_batches(picked, make, "doc_id long, kind int, row binary").groupBy("doc_id", "kind").agg(F.min("row").alias("row")).select("kind", "row").orderBy("kind", "row").collect()
    width = len(SHAPE) + (1 << BITS)
    cut = [np.array([np.frombuffer(r, np.float16) for k, r in rows if k == kind], np.float32).reshape(-1, width) for kind in (1, 0)]
    return cut[0], cut[1]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x_p: np.ndarray, x_u: np.ndarray, prior: float | None) -> np.ndarray:
    """Weights of the linear score. prior None: plain positives against unlabelled; else the non-negative risk."""
    x_p, x_u = x_p.astype(np.float32), x_u.astype(np.float32)
    w, m, v = np.zeros(x_p.shape[1], np.float32), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        z_p, z_u = np.clip(x_p @ w, -40, 40), np.clip(x_u @ w, -40, 40)
        s_p, s_u = sigmoid(z_p) / len(x_p), sigmoid(z_u) / len(x_u)
        if prior is None:
            g = (s_p - 1 / len(x_p)) @ x_p + s_u @ x_u
        elif np.logaddexp(0, z_u).mean() >= prior * np.logaddexp(0, z_p).mean():
            g = -prior / len(x_p) * x_p.sum(0) + s_u @ x_u  # prior * (R_p(+1) - R_p(-1)) is linear
        else:  # where the estimated risk of negatives falls below zero, it is raised again
            g = prior * (s_p @ x_p) - s_u @ x_u
        g = g + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - np.float32(RATE) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w.astype(np.float64)


def class_prior(x_p: np.ndarray, x_u: np.ndarray) -> float:
    """Share of positives among the unlabelled: least ratio of what both put above a cut, on rows not fitted on."""
    w = fit(x_p[::2], x_u[::2], None)
    p, u = np.sort(x_p[1::2] @ w)[::-1], np.sort(x_u[1::2] @ w)[::-1]
    best = 1.0
    for k in range(max(1, len(p) // 20), len(p) + 1, max(1, len(p) // 200)):
        share = k / len(p)
        over = np.searchsorted(-u, -p[k - 1], "right") / len(u)
        margin = np.sqrt(np.log(40) / 2 / len(p)) + np.sqrt(np.log(40) / 2 / len(u))
        if (over + margin) / share < best + margin / share:
            best = min(best, over / share)
    return float(np.clip(best, 0.05, 0.98))


class QualityModel:
    """Linear score over standardised features, folded into weights for whole texts."""

    def __init__(self, x_p: np.ndarray, x_u: np.ndarray, prior: float | None = None):
        if not len(x_p) or not len(x_u):
            self.prior, self.shape_weights, self.gram_weights = 1.0, np.zeros(len(SHAPE)), np.zeros(1 << BITS, np.float32)
            return
        scale = np.r_[x_p, x_u].std(0) + 1e-3
        middle = np.r_[x_p, x_u].mean(0)
        scale[0], middle[0] = 1, 0
        x_p, x_u = (x_p - middle) / scale, (x_u - middle) / scale
        self.prior = class_prior(x_p, x_u) if prior is None else prior
        w = fit(x_p, x_u, self.prior) / scale
        w[0] -= w[1:] @ middle[1:]
        self.shape_weights, self.gram_weights = w[: len(SHAPE)], w[len(SHAPE) :].astype(np.float32)

    def score(self, found: list[bytes]) -> np.ndarray:
        """Probability of good quality for each text. Without words there is nothing to trust: 0."""
        shapes = np.array([shape(t) for t in found]).reshape(-1, len(SHAPE))
        s = sigmoid(shapes @ self.shape_weights + mean_weights(found, self.gram_weights, ORDER, BITS))
        return np.where(shapes[:, 1:].any(1), np.round(s, 9), 0.0)


def fit_quality(docs: DataFrame, positives: DataFrame, n_positive: int = POSITIVES, n_other: int = UNLABELLED) -> QualityModel:
    return QualityModel(*sample_features(docs, positives, n_positive, n_other))


def score_quality(docs: DataFrame, model: QualityModel, to: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1. Null and empty texts score 0; a column named as ``to`` is replaced; rows
    with equal texts score alike."""
    kept = docs.drop(to)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{to}` double"])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(texts(b)), pa.float64())], names=[*b.schema.names, to])

    return map_batches(kept, run, schema)


def trusted_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where((F.col("quality") == 1) & ~held_out()).select("doc_id")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, trusted_positives(spark, sf_dir))
    out = score_quality(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
