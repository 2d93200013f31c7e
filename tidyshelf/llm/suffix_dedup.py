"""Repeated substrings by prefix-free parsing, in Spark.

What is asked: each byte that lies in a string of ``width`` bytes that also starts earlier in the
corpus (in a document of smaller id, or earlier in the same one). For that the suffixes of the corpus
need an order to depth ``width`` only.

Parsing. A rolling hash runs over each text; the least hash among the ``REACH`` places after a suffix's
start is its trigger. Suffixes in a row with one trigger make a phrase, and a phrase carries the bytes
up to the end of its last suffix's first ``width`` bytes. Trigger and phrase depend on those bytes
alone, so equal strings have equal triggers, and the bytes at the trigger (its unit) are in both.

Dictionary. Equal phrases are one word of the dictionary; their places are the parse, in order. Of a
word's places only the first can hold suffixes that are new. A unit found once in the corpus belongs to
a phrase whose suffixes are all new; most phrases end here.

Combining. What is left are first places of words whose unit stands in several words. Their suffixes,
but for those that contain another unit found once, are ranked one by one by the 128-bit digests of
their first ``width`` bytes (equality is all that is asked of the order), and in each rank all places
but the first are repeats.

Scale. One shuffle of about one row of four numbers for each 24 bytes of text; texts are shuffled packed
with zstd, once for both joins. A slice of a task keeps the first of equal phrases, and of equal suffixes, for itself, and a
unit with several words in a slice is known to be shared there; so what a hot passage sends to one task
grows with the number of slices, not of documents. Nothing is gathered but the places of one document.

Defined cases: a null text is empty; texts below ``width`` bytes have no repeats; rows of one id, or
without one, are ordered by text, nulls first, and each gets its own result; an empty table gives no
rows. A text may have up to 2 ** 30 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from tidyshelf.llm import frames
from tidyshelf.session import cut

WIDTH = 100
#: Bytes the rolling hash sees, and places among which a trigger is the least.
GRAM, REACH = 8, 48
_PLACE_BITS = np.uint64(30)
_BYTES = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15

# Kinds of phrase rows. Only the asking ones meet by unit: plain; known to stand in several words;
# known to stand twice in one word. The others are a further word of a known unit, and a repeat.
_ASK, _SHARED, _REPEAT, _ASK_SHARED, _ASK_TWICE = range(5)


def rolling(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` (a power of two) bytes at each place where so many follow."""
    hashes, factor, size = _BYTES[data], _BASE, 1
    while size < gram:
        hashes = hashes[:-size] * np.uint64(factor) + hashes[size:] if len(hashes) > size else hashes[:0]
        factor, size = factor * factor % (1 << 64), 2 * size
    hashes ^= hashes >> np.uint64(31)
    return hashes * np.uint64(0xD6E8FEB86659FD93)


def triggers(data: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Place of the trigger of each suffix that has ``reach`` places with a hash after it."""
    least = (rolling(data) >> _PLACE_BITS) << _PLACE_BITS
    least |= np.arange(len(least), dtype=np.uint64)
    size = 1
    while size < reach:
        step = min(size, reach - size)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        size += step
    return (least & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)


def phrases(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start in the data, places, suffixes, trigger) of the phrases of texts laid end to end.
    The last places of a text have a trigger, but fewer than ``width`` bytes; they are no suffixes.
    Phrases whose unit would pass the text's end are left out."""
    found = triggers(data)
    valid = np.zeros(len(found) + 1, bool)
    for a, n in zip(offsets[:-1].tolist(), np.diff(offsets).tolist()):
        if n >= REACH + GRAM - 1:
            valid[a:a + n - REACH - GRAM + 2] = True
    valid[-1] = False
    new = valid[:-1].copy()
    new[1:] &= ~valid[:-2] | (found[1:] != found[:-1])
    starts = np.flatnonzero(new)
    stops = np.flatnonzero(valid[:-1] & (~valid[1:] | np.append(new[1:], True))) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    # texts may be empty: the last of equal offsets is the text that is not
    ends = offsets[doc + 1]
    suffixes_ = np.clip(np.minimum(stops, ends - width + 1) - starts, 0, None)
    fits = found[starts] + width - REACH + 1 <= ends
    return tuple(x[fits] for x in (doc, starts, stops - starts, suffixes_, found[starts]))


def signed(values) -> np.ndarray:
    return np.fromiter(values, np.uint64).view(np.int64)


def parse(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """Phrase rows (unit, word, doc, place) of texts (doc, text); place holds the start, the number of
    suffixes and the kind: start * 1024 + suffixes * 8 + kind."""
    unit_size = width - REACH + 1

    def rows(batches):
        for part in frames.slices(batches):
            data, offsets = frames.utf8(part.column("text"))
            ids = part.column("doc").to_numpy(zero_copy_only=False)
            doc, start, _, count, trigger = phrases(data, offsets, width)
            if not len(doc):
                continue
            whole = data.tobytes()
            unit = signed(xxh3_64_intdigest(whole[a:a + unit_size]) for a in trigger.tolist())
            stop = np.minimum(start + np.maximum(count, 1) - 1 + width, offsets[doc + 1])
            word = signed(xxh3_64_intdigest(whole[a:b]) for a, b in zip(start.tolist(), stop.tolist()))
            doc_id, at = ids[doc], start - offsets[doc]
            order = np.lexsort((at, doc_id, word, unit))
            unit, word, doc_id, at, count = (x[order] for x in (unit, word, doc_id, at, count))
            fresh = np.ones(len(unit), bool)
            fresh[1:] = (unit[1:] != unit[:-1]) | (word[1:] != word[:-1])
            kind = np.where(fresh, _ASK, _REPEAT)
            kind[:-1][fresh[:-1] & ~fresh[1:]] = _ASK_TWICE
            # of a unit's different words, the first asks and tells, the others are shared for certain
            kept = np.flatnonzero(fresh)
            again = np.zeros(len(kept) + 1, bool)
            again[1:-1] = unit[kept[1:]] == unit[kept[:-1]]
            kind[kept[again[:-1]]] = _SHARED
            kind[kept[again[1:] & ~again[:-1]]] = _ASK_SHARED
            back = np.argsort(order)  # in the order of the texts the rows pack better
            unit, word, doc_id, at, count, kind = (x[back] for x in (unit, word, doc_id, at, count, kind))
            yield pa.RecordBatch.from_arrays(
                [pa.array(unit), pa.array(word), pa.array(doc_id), pa.array(at * 1024 + count * 8 + kind)],
                ["unit", "word", "doc", "place"])

    return texts.mapInArrow(rows, "unit long, word long, doc long, place long")


def candidates(rows: DataFrame) -> DataFrame:
    """The phrases that may hold repeats: (unit, word, doc, start, n, shared, repeat). ``shared``: the
    unit stands in several words; ``repeat``: an equal phrase comes before in the same slice."""
    asks = (F.col("place") % 8).isin(_ASK, _ASK_SHARED, _ASK_TWICE)
    dealt = rows.repartition(F.when(asks, F.col("unit")).otherwise(F.xxhash64("word", "doc"))) \
        .sortWithinPartitions("unit")

    def scan(batches):
        held: list[np.ndarray] = []  # the rows of the unit that may go on

        def judge(unit, word, doc, place):
            kind = place % 8
            ask = (kind == _ASK) | (kind >= _ASK_SHARED)
            keep, shared = ~ask, kind == _SHARED
            rows_ = np.flatnonzero(ask)
            if len(rows_):
                own = unit[rows_]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(own))))
                size = np.bincount(group)
                told = np.bincount(group, kind[rows_] == _ASK_SHARED) > 0
                twice = np.bincount(group, kind[rows_] == _ASK_TWICE) > 0
                several = np.maximum.reduceat(word[rows_], first) != np.minimum.reduceat(word[rows_], first)
                keep[rows_] = ((size > 1) | told | twice)[group]
                shared[rows_] = (several | told)[group]
            return pa.RecordBatch.from_arrays(
                [pa.array(unit[keep]), pa.array(word[keep]), pa.array(doc[keep]),
                 pa.array(place[keep] // 1024), pa.array(place[keep] % 1024 // 8),
                 pa.array(shared[keep]), pa.array(kind[keep] == _REPEAT)],
                ["unit", "word", "doc", "start", "n", "shared", "repeat"])

        for batch in batches:
            own = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in
                            ("unit", "word", "doc", "place")])
            if not own.shape[1]:
                continue
            last = np.searchsorted(own[0], own[0][-1])  # where the batch's last unit begins
            if last == 0 and (not held or held[0][0][0] == own[0][0]):
                held.append(own)
                continue
            yield judge(*np.concatenate([*held, own[:, :last]], axis=1))
            held = [own[:, last:]]
        if held:
            yield judge(*np.concatenate(held, axis=1))

    return dealt.mapInArrow(scan, "unit long, word long, doc long, start long, n long, "
                                  "shared boolean, repeat boolean")


def packed(texts: DataFrame) -> DataFrame:
    """(doc_id, doc, packed): the texts as zstd."""
    def rows(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for part in frames.slices(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("doc"), pa.array(
                    [squeeze.compress(t) for t in frames.encoded(part.column("text"))], pa.binary())],
                ["doc_id", "doc", "packed"])

    return texts.select("doc_id", "doc", "text").mapInArrow(
        rows, "doc_id long, doc long, packed binary")


def by_size(batches, column: str = "packed", limit: int = frames.SLICE_BYTES // 4):
    """Slices of batches by the size of a binary column."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(sizes):
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def unpack(column) -> list[bytes]:
    expand = zstandard.ZstdDecompressor()
    return [expand.decompress(x) for x in column.to_pylist()]


def open_suffixes(data: np.ndarray, offsets: np.ndarray, held: np.ndarray, asked: np.ndarray,
                  width: int) -> np.ndarray:
    """Places of the suffixes to rank, of texts laid end to end: those of the phrases that start at
    ``asked``, but for such as contain a unit found once in the corpus (one of no phrase that starts at
    ``held``). Only triggers that the first ``width`` bytes of the suffix settle count for that, as an
    equal string then has them too."""
    _, start, places, count, trigger = phrases(data, offsets, width)
    wanted = np.zeros(len(data) + 1, np.int64)
    own = np.isin(start, asked)
    np.add.at(wanted, start[own], 1)
    np.add.at(wanted, start[own] + count[own], -1)
    single = ~np.isin(start, held)
    slack = width - GRAM - REACH + 1
    closed = np.zeros(len(data) + 1, np.int64)
    first = np.maximum(np.maximum(start - slack, trigger - REACH + 1), 0)[single]
    np.add.at(closed, first, 1)
    np.add.at(closed, (start + places)[single], -1)
    return np.flatnonzero((np.cumsum(wanted)[:-1] > 0) & (np.cumsum(closed)[:-1] == 0))


def suffixes(words: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(a, b, doc, start, repeat): digest and place of the suffixes to rank. ``words``: all phrases with
    a unit found twice or more (doc, start, ask: whether it is a first place of a shared one). Repeat
    where an equal suffix comes before in the same slice."""
    places = words.groupBy("doc").agg(F.collect_list(F.struct("start", "ask")).alias("places"),
                                      F.max("ask").alias("any")).where("any")

    def rows(batches):
        asked = (b.filter(pc.is_valid(b.column("places"))) for b in batches)
        for part in by_size(asked):
            ids = np.array(part.column("doc").to_pylist(), np.int64)
            texts_ = unpack(part.column("packed"))
            whole = b"".join(texts_)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts_])])
            lists = part.column("places")
            of = np.repeat(offsets[:-1], pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            start = flat.field(0).to_numpy() + of
            ask = flat.field(1).to_numpy(zero_copy_only=False)
            at = open_suffixes(np.frombuffer(whole, np.uint8), offsets, start, start[ask], width)
            doc = np.searchsorted(offsets, at, side="right") - 1
            digests = b"".join(xxh3_128_digest(whole[i:i + width]) for i in at.tolist())
            a, b = np.frombuffer(digests, np.int64).reshape(-1, 2).T
            doc_id, at = ids[doc], at - offsets[doc]
            order = np.lexsort((at, doc_id, b, a))
            again = np.zeros(len(a), bool)
            again[order[1:]] = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, (a, b, doc_id, at, again))], ["a", "b", "doc", "start", "repeat"])

    # joined as in the end, with all columns and rows, so that one shuffle of the texts serves both
    return texts.join(places, "doc", "left").select("doc_id", "doc", "packed", "places").mapInArrow(
        rows, "a long, b long, doc long, start long, repeat boolean")


def ordered(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, text): doc orders the rows as the corpus goes and tells them apart. It is the id
    itself unless ids are missing or repeated; then the rows are sorted and numbered once."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    once = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(
        "n > 1 OR doc_id IS NULL").limit(1).count() == 0
    if once:
        return docs.withColumn("doc", F.col("doc_id"))
    return cut(docs.orderBy(F.asc_nulls_first("doc_id"), "text").withColumn(
        "doc", F.monotonically_increasing_id()))


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_bytes, spans (maximal repeated runs, start and end in bytes) and kept (the
    remaining bytes)."""
    if width < REACH + GRAM - 1:
        raise ValueError(f"width must be at least {REACH + GRAM - 1}")
    rows = ordered(docs)
    texts = packed(rows)
    # rows known as repeats are alone in their window
    alone = F.when(F.col("repeat"), F.xxhash64("doc", "start"))
    place = W.partitionBy("unit", "word", alone).orderBy("doc", "start")
    words = cut(candidates(parse(rows.select("doc", "text"), width)).select(
        "doc", "start", "n", "shared",
        (~F.col("repeat") & (F.row_number().over(place) == 1)).alias("first")))
    ranked = suffixes(words.select("doc", "start", F.expr("first AND shared AND n > 0").alias("ask")),
                      texts, width)
    in_rank = W.partitionBy("a", "b", alone).orderBy("doc", "start")
    later = ranked.select("doc", "start", F.lit(1).cast("long").alias("n"), (
        F.col("repeat") | (F.row_number().over(in_rank) > 1)).alias("later")).where("later")
    # no cut here: in one plan the shuffled texts serve both joins
    marks = words.where("NOT first AND n > 0").select("doc", "start", "n").unionByName(later.drop("later"))
    by_doc = marks.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("places"))

    def finish(batches):
        for part in by_size(batches):
            sizes, spans, kept = [], [], []
            for text, own in zip(unpack(part.column("packed")), part.column("places")):
                sizes.append(len(text))
                if not own.is_valid:
                    spans.append([])
                    kept.append(text)
                    continue
                start, n = (own.values.field(k).to_numpy() for k in (0, 1))
                change = np.zeros(len(text) + 1, np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, start + n - 1 + width, -1)
                gone = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
                edges = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)
                spans.append([{"start": a, "end": b} for a, b in edges.tolist()])
                kept.append(np.frombuffer(text, np.uint8)[~gone[1:-1]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return texts.join(by_doc, "doc", "left").select("doc_id", "doc", "packed", "places").mapInArrow(
        finish, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
