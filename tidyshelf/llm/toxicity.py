"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows and a sample of unlabelled rows train a linear classifier in numpy. The risk is
``prior * E_p[l(f, +1)] + max(0, E_u[l(f, -1)] - prior * E_p[l(f, -1)])``: what the toxic share of the
unlabelled rows adds to their negative risk is taken out, and where that estimate turns negative the
step goes against it, so that the classifier can't fit the unlabelled rows beyond the prior.

Features are the words of a text and their beginnings of 4 to 8 bytes, hashed. A feature found ``c``
times among ``n`` words counts as ``c / (c + HALF * n)``, so one hit in a long text weighs little. The
rows that hold each are summed by Spark; the ``FEATURES`` that differ most between the two samples are
kept, and only those reach the trainer. The score of a text is the logistic of the weighted sum.

Training data are bounded: ``POSITIVES`` and ``UNLABELLED`` rows at most, chosen by hash of their ids
from the rows that may be learnt from (crc32 of the id modulo 4 is not 2). Labels other than toxic = 1
serve for the prior alone.

Defined cases: a null or empty text has no features and scores by the bias; without toxic rows all
scores are 0; repeated rows count and are judged each; labels of unknown documents are passed over; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidyshelf.llm import frames

POSITIVES, UNLABELLED, FEATURES = 3_000, 6_000, 512
#: A feature must stand in this many sampled rows, and differ by this many standard errors.
LEAST_ROWS, LEAST_Z = 5, 5.0
#: Share of a text's words at which a feature counts half.
HALF = 0.02
STARTS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
              for c in range(256))
#: Words a worker remembers the features of.
_REMEMBER = 200_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def features_of(word: bytes) -> list[int]:
    """The word as a whole, and its beginnings, as signed 64-bit numbers."""
    keys = [xxh64_intdigest(word, 1)]
    keys += [xxh64_intdigest(word[:k], 2) for k in STARTS if k <= len(word)]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


class Features:
    """Values of the wanted features of a text, with a bounded memory of words."""

    def __init__(self, wanted):
        self.wanted = wanted
        self.known: dict[bytes, tuple[int, ...]] = {}

    def of(self, text: bytes) -> dict[int, float]:
        words = words_of(text)
        counts: dict[int, int] = {}
        for word, times in Counter(words).items():
            found = self.known.get(word)
            if found is None:
                if len(self.known) >= _REMEMBER:
                    self.known.clear()
                found = self.known[word] = tuple(f for f in features_of(word) if f in self.wanted)
            for f in found:
                counts[f] = counts.get(f, 0) + times
        return {f: counts[f] / (counts[f] + HALF * len(words)) for f in sorted(counts)}


@dataclass
class Model:
    """Weight of each feature, and the bias."""

    weights: dict[int, float]
    bias: float
    prior: float


def risk_step(x_p: np.ndarray, x_u: np.ndarray, w: np.ndarray, b: float, prior: float
              ) -> tuple[np.ndarray, float, float]:
    """Gradient of the non-negative risk under the logistic loss, and its negative part."""
    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    z_p, z_u = x_p @ w + b, x_u @ w + b
    s_p, s_u = sigmoid(z_p), sigmoid(z_u)
    negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
    to_neg_u, to_neg_p = s_u / len(s_u), s_p * (prior / len(s_p))
    if negative < 0:  # only the over-fitted part is undone
        return x_p.T @ to_neg_p - x_u.T @ to_neg_u, to_neg_p.sum() - to_neg_u.sum(), negative
    to_pos = (s_p - 1) * (prior / len(s_p))
    return (x_p.T @ (to_pos - to_neg_p) + x_u.T @ to_neg_u,
            to_pos.sum() - to_neg_p.sum() + to_neg_u.sum(), negative)


def train(x_p: np.ndarray, x_u: np.ndarray, prior: float, steps: int = 400, rate: float = 0.03,
          decay: float = 5e-4) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk with weight decay; rows hold feature values."""
    w = np.zeros(x_p.shape[1] + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        g_w, g_b, _ = risk_step(x_p, x_u, w[:-1].astype(np.float32), w[-1], prior)
        g = np.append(g_w + decay * w[:-1], g_b)
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES,
                  unlabelled: int = UNLABELLED) -> tuple[DataFrame, float]:
    """(text, toxic) of the two samples, and the share of toxic rows among the labelled ones."""
    seen = labels.where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))
                        & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    total, toxic = seen.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    prior = (toxic or 0) / total if total else 0.0
    chosen = seen.where("toxic = 1").select("doc_id").distinct().orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(positives).withColumn("_toxic", F.lit(True))
    n = max(1, docs.count())
    hashed = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(n))
    rows = docs.select("doc_id", "text").where(~is_held_out(F.col("doc_id"))).join(
        F.broadcast(chosen), "doc_id", "left").where(F.col("_toxic") | (hashed < unlabelled))
    return rows.select(F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce("_toxic", F.lit(False)).alias("toxic")), prior


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
        features: int = FEATURES) -> Model:
    rows, prior = training_rows(docs, labels, positives, unlabelled)
    if not 0 < prior < 1:
        return Model({}, -np.inf if prior <= 0 else np.inf, prior)

    def count(batches):
        """Rows of each kind that have a feature, and (feature null) rows of each kind."""
        for part in frames.slices(batches):
            flags = np.array(part.column("toxic").to_pylist(), bool)
            sets = [np.array(sorted({f for w in set(words_of(t)) for f in features_of(w)}), np.int64)
                    for t in frames.encoded(part.column("text"))]
            keys, place = np.unique(np.concatenate(sets), return_inverse=True)
            owner = np.repeat(flags, [len(s) for s in sets])
            pos = np.bincount(place, owner, minlength=len(keys)).astype(np.int64)
            every = np.bincount(place, minlength=len(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array([*keys.tolist(), None], pa.int64()),
                 pa.array([*pos.tolist(), int(flags.sum())], pa.int64()),
                 pa.array([*(every - pos).tolist(), int((~flags).sum())], pa.int64())],
                ["feature", "pos", "unl"])

    counts = rows.mapInArrow(count, "feature long, pos long, unl long").groupBy("feature").agg(
        F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))
    sums = counts.where("feature IS NULL").first()
    if not sums or not sums["pos"] or not sums["unl"]:
        return Model({}, -np.inf, prior)
    n_pos, n_unl = sums["pos"], sums["unl"]
    pooled = (F.col("pos") + F.col("unl") + 1) / F.lit(n_pos + n_unl + 2)
    z = F.abs(F.col("pos") / n_pos - F.col("unl") / n_unl) / F.sqrt(
        pooled * (1 - pooled) * F.lit(1 / n_pos + 1 / n_unl))
    kept = counts.where(F.col("feature").isNotNull() & (F.col("pos") + F.col("unl") >= LEAST_ROWS)
                        & (z >= LEAST_Z)).orderBy(z.desc(), "feature").limit(features)
    names = [r["feature"] for r in kept.select("feature").collect()]
    column = {name: i for i, name in enumerate(names)}

    def project(batches):
        features = Features(column)
        for part in frames.slices(batches):
            found = [features.of(t) for t in frames.encoded(part.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [part.column("toxic"),
                 pa.array([[column[f] for f in own] for own in found], pa.list_(pa.int32())),
                 pa.array([list(own.values()) for own in found], pa.list_(pa.float32()))],
                ["toxic", "columns", "values"])

    sample = rows.mapInArrow(
        project, "toxic boolean, columns array<int>, values array<float>").toPandas()
    x = np.zeros((len(sample), len(names)), np.float32)
    for i, (own, values) in enumerate(zip(sample["columns"], sample["values"])):
        x[i, own] = values
    toxic = sample["toxic"].to_numpy(bool)
    weights, bias = train(x[toxic], x[~toxic], prior)
    return Model(dict(zip(names, weights.tolist())), bias, prior)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and prediction of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        model = shared.value
        features = Features(model.weights)
        for part in frames.slices(batches):
            sums = [model.bias + sum(model.weights[f] * v for f, v in features.of(text).items())
                    for text in frames.encoded(part.column("text"))]
            scores = 1 / (1 + np.exp(-np.clip(np.array(sums), -700, 700)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(scores),
                 pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), is_held_out(F.col("doc_id")).alias("held_out"),
                       "text").mapInArrow(
        rows, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
