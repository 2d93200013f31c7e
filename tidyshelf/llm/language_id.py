"""Language ID: bit-sliced Bloom filters that return the languages of an n-gram as a bit mask.

Training counts the byte trigrams of the folded texts by language, over all training rows; a language's
filter holds the trigrams whose share in it is at least ``SHARE`` of their share in the language that
uses them most, and which is not below ``RATE`` of all its trigrams. The filters are slices of one table: cell ``h`` holds
one bit per language, so the AND of ``PROBES`` cells answers for all languages at once. A document's
trigrams are looked up together; for each language the set bits are counted, the filter's measured
rate of false positives is taken out, and the language with the most wins.

The table has a fixed size and is all that the driver gets; the counts that make it stay in Spark.

Defined cases: a null text or one without a letter is ``und`` with score 0; without training rows all
others are ``und`` too; ties go to the name that sorts first; repeated rows count and are judged each;
a letter is a character of one of Unicode's letter categories; all languages named are told apart, at
8 MB of the table for each 64 of them; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidyshelf.llm import frames
from tidyshelf.session import cut

NONE = "und"
#: Cells of the table (a power of two), probes of an n-gram, least share of the n-gram in a language: of
#: the highest share in any language, and of all its n-grams.
CELLS, PROBES, SHARE, RATE = 1 << 20, 2, 0.25, 1e-7
#: Languages of one word of a cell; a cell has as many words as the languages need.
WORD = 64
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))

#: A-Z become a-z, all other ASCII but a-z becomes a blank, bytes of other scripts stay.
_FOLD = np.array([c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
                  for c in range(256)], np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte trigrams of texts laid end to end, and the text each belongs to. Trigrams that would cross
    two texts, or hold two blanks, are left out."""
    folded = _FOLD[data].astype(np.uint32)
    if len(folded) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    codes = (folded[:-2] << 16) | (folded[1:-1] << 8) | folded[2:]
    blank = folded == 0x20
    good = (blank[:-2].astype(np.int8) + blank[1:-1] + blank[2:]) < 2
    for end in (offsets[1:-1] - 1, offsets[1:-1] - 2):
        inside = end[(end >= 0) & (end < len(good))]
        good[inside] = False
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:-2]
    return codes[good], owner[good]


def cells(codes: np.ndarray) -> list[np.ndarray]:
    shift = np.uint64(64 - (CELLS.bit_length() - 1))
    return [((codes.astype(np.uint64) + np.uint64(1)) * mix >> shift).astype(np.int64) for mix in _MIX]


@dataclass
class Filters:
    """``table`` has a bit per language in each cell, in rows of ``WORD`` languages; ``false`` is each
    filter's false-positive rate."""

    names: list[str]
    table: np.ndarray
    false: np.ndarray

    def masks(self, codes: np.ndarray) -> list[np.ndarray]:
        first, second = cells(codes)
        return [word[first] & word[second] for word in self.table]


def build(names: list[str], table: np.ndarray) -> Filters:
    """Filters out of the table, with their false-positive rates."""
    filled = np.array([(table[b // WORD] >> np.uint64(b % WORD) & np.uint64(1)).mean() for b in range(len(names))])
    return Filters(names, table, filled ** PROBES)


def fit(docs: DataFrame) -> Filters:
    """Counts the trigrams of all rows that may be learnt from, and sets the bits of those that are kept.
    Only the cells with a bit reach the driver, at most ``CELLS`` of them."""
    known = docs.where("lang IS NOT NULL")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for part in frames.slices(batches):
            learn = ~frames.held_out(part.column("doc_id"))
            part = part.filter(pa.array(learn))
            names = np.array(part.column("lang").to_pylist(), object)
            data, offsets = frames.utf8(part.column("text"))
            codes, owner = grams(data, offsets)
            for name in sorted(set(names.tolist())):
                some = np.bincount(codes[(names == name)[owner]], minlength=1)
                used = np.flatnonzero(some)
                old = sums.get(name)
                if old is not None:
                    used, place = np.unique(np.concatenate([old[0], used]), return_inverse=True)
                    total = np.bincount(place, np.concatenate([old[1], some[some > 0]])).astype(np.int64)
                else:
                    total = some[used]
                sums[name] = np.stack([used, total])
        for name, (used, total) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used)), pa.array(used.astype(np.int64)),
                 pa.array(total.astype(np.int64))], ["lang", "gram", "n"])

    sums = known.select(F.col("doc_id").cast("long"), "text", "lang").mapInArrow(
        count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = cut(sums)
    totals = {r["lang"]: r["n"] for r in sums.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals)
    table = np.zeros((-(-len(names) // WORD), CELLS), np.uint64)
    if names:
        bits = sums.sparkSession.createDataFrame(
            [(name, totals[name], k // WORD, 1 << k % WORD if k % WORD < 63 else -1 << 63) for k, name in enumerate(names)],
            "lang string, total long, word int, mask long")
        share = F.col("n") / F.col("total")
        kept = sums.join(F.broadcast(bits), "lang").select("gram", "word", "mask", share.alias("share")).withColumn(
            "top", F.max("share").over(W.partitionBy("gram"))).where(
            (F.col("share") >= SHARE * F.col("top")) & (F.col("share") >= RATE))

        def place(batches):
            for batch in batches:
                codes = batch.column("gram").to_numpy(zero_copy_only=False)
                for at in cells(codes):
                    yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(at), batch.column("mask")],
                                                     ["word", "cell", "mask"])

        filled = kept.select("word", "gram", "mask").mapInArrow(place, "word int, cell long, mask long").groupBy(
            "word", "cell").agg(F.bit_or("mask").alias("mask")).toPandas()
        table[filled["word"], filled["cell"]] = filled["mask"].to_numpy(np.int64).view(np.uint64)
    return build(names, table)


def language_id(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the winner's share of all corrected counts) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def rows(batches):
        model = shared.value
        names = [*model.names, NONE]
        for part in frames.slices(batches):
            data, offsets = frames.utf8(part.column("text"))
            n = part.num_rows
            codes, owner = grams(data, offsets)
            masks = model.masks(codes)
            total = np.bincount(owner, minlength=n)
            fit_ = np.zeros((len(model.names), n))
            for bit, rate in enumerate(model.false):
                hits = np.bincount(owner, (masks[bit // WORD] >> np.uint64(bit % WORD) & np.uint64(1)).astype(float), n)
                fit_[bit] = np.maximum(0, (hits - rate * total) / (1 - rate))
            whole = fit_.sum(axis=0)
            best = fit_.argmax(axis=0) if len(model.names) else np.zeros(n, np.int64)
            share = np.divide(fit_.max(axis=0), whole, out=np.zeros(n), where=whole > 0) \
                if len(model.names) else np.zeros(n)
            letters = np.fromiter((any(map(str.isalpha, t or ""))
                                   for t in part.column("text").to_pylist()), bool, n)
            best = np.where(letters, best, len(model.names))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(frames.held_out(part.column("doc_id"))),
                 pa.array([names[b] for b in best]), pa.array(np.where(letters, share, 0.0))],
                ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        rows, "doc_id long, held_out boolean, lang_pred string, score double")


def predict(docs: DataFrame) -> DataFrame:
    return language_id(docs, fit(docs))
