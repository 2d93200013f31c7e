"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text, plus fixed counts.

Words and pairs of words fall into ``BUCKETS`` by hash. One pass over all documents counts the
buckets of the raw corpus and of the trusted documents; the trusted multinomial, smoothed by the raw one, over the raw
one gives each bucket a log ratio; a document's score is the mean ratio of its words and pairs, and the document
is kept if no fixed rule rejects it and the score reaches ``FLOOR``.

Defined cases: a null, empty or blank text has no words, score 0, and fails the base rule. Repeated
rows are counted and judged one by one. Without trusted documents all ratios are 0 and only the
base rule rejects. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidyshelf.llm import frames

#: Fixed by design: the model has this many numbers whatever the corpus.
BUCKETS = 1 << 16
#: Least mean log ratio of a kept document, in nats a word or pair.
FLOOR = -0.21
#: Trusted rows used at most (lowest hashes of their ids); they are broadcast as ids.
LABELLED = 50_000
#: Raw-corpus pseudo counts of a mean bucket: few trusted rows leave the ratios near 0.
PRIOR = 2

_BLANK, _SYMBOLS = b"\t\n\x0b\x0c\r ", b"#*$%&|<>"
_PAIR = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_RUN = np.uint64(0x9E3779B97F4A7C15)

COLUMNS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
           "n_repeat_words long, base_failed boolean, kept boolean, score double")


def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def buckets(hashes: np.ndarray) -> np.ndarray:
    """Bucket of each word and of each pair of neighbours."""
    pairs = hashes[:-1] * _PAIR[0] + (hashes[1:] ^ (hashes[1:] >> np.uint64(29))) * _PAIR[1]
    return (np.concatenate([hashes, pairs]) >> np.uint64(48)).astype(np.int64)


def repeated_words(hashes: np.ndarray, width: int = 8) -> int:
    """Words that lie in a window of ``width`` words found at least twice."""
    n = len(hashes) - width + 1
    if n < 2:
        return 0
    keys = np.zeros(n, np.uint64)
    for i in range(width):
        keys = keys * _RUN + hashes[i:i + n]
        keys ^= keys >> np.uint64(31)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [line for line in text.split(b"\n") if line.strip(_BLANK)]
    return len(lines) - len(set(lines))


def trusted_ids(labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """Ids of at most ``limit`` trusted documents, chosen by hash."""
    return (labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))


def fit(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Log ratio of each bucket, from the counts of all documents."""
    marked = docs.select("doc_id", "text").join(
        F.broadcast(trusted.select("doc_id", F.lit(True).alias("_trusted"))), "doc_id", "left"
    ).select("text", F.coalesce("_trusted", F.lit(False)).alias("_trusted"))

    def count(batches):
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for part in frames.slices(batches):
            flags = part.column("_trusted").to_pylist()
            found = [buckets(word_hashes(text)) for text in frames.encoded(part.column("text"))]
            raw += np.bincount(np.concatenate(found), minlength=BUCKETS)
            if trusted_here := [x for x, flag in zip(found, flags) if flag]:
                good += np.bincount(np.concatenate(trusted_here), minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(good[used])],
            ["bucket", "raw", "good"])

    counts = marked.mapInArrow(count, "bucket int, raw long, good long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]], good[counts["bucket"]] = counts["raw"], counts["good"]
    if not good.any():
        return np.zeros(BUCKETS)
    whole = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    weight = PRIOR * BUCKETS
    return np.log((good / whole + weight) / (good.sum() + weight))


def judge(docs: DataFrame, ratios: np.ndarray, floor: float = FLOOR) -> DataFrame:
    """Counts, score and verdict of every document."""
    model = docs.sparkSession.sparkContext.broadcast(ratios)

    def rows(batches):
        weights = model.value
        for part in frames.slices(batches):
            texts = frames.encoded(part.column("text"))
            out = np.zeros((len(texts), 5), np.int64)
            scores = np.zeros(len(texts))
            for i, text in enumerate(texts):
                hashes = word_hashes(text)
                solid = text.translate(None, _BLANK)
                out[i] = (len(hashes), len(solid.decode()),
                          len(text) - len(text.translate(None, _SYMBOLS)),
                          duplicate_lines(text), repeated_words(hashes))
                if len(hashes):
                    scores[i] = weights[buckets(hashes)].mean()
            failed = (out[:, 0] < 20) | (100 * out[:, 4] > 30 * out[:, 0])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *map(pa.array, out.T.copy()), pa.array(failed),
                 pa.array(~failed & (scores >= floor)), pa.array(scores)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                 "n_repeat_words", "base_failed", "kept", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, COLUMNS)


def quality_rules(docs: DataFrame, labels: DataFrame, floor: float = FLOOR,
                  limit: int = LABELLED) -> DataFrame:
    """One row per document with its counts, score and verdict."""
    return judge(docs, fit(docs, trusted_ids(labels, limit)), floor)


def keep_good(docs: DataFrame, labels: DataFrame, floor: float = FLOOR,
              limit: int = LABELLED) -> DataFrame:
    """The documents that the rules keep, with all columns, judged without a shuffle of texts."""
    ratios = docs.sparkSession.sparkContext.broadcast(fit(docs, trusted_ids(labels, limit)))

    def rows(batches):
        weights = ratios.value
        for part in frames.slices(batches):
            keep = []
            for text in frames.encoded(part.column("text")):
                hashes = word_hashes(text)
                n = len(hashes)
                keep.append(n >= 20 and 100 * repeated_words(hashes) <= 30 * n
                            and weights[buckets(hashes)].mean() >= floor)
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
