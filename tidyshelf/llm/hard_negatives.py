"""Hard negatives from Hilbert-ordered candidate blocks with zone maps.

Entries become whole numbers, so all scores are exact. Rows are dealt out by label and by their place on
a Hilbert curve through the dimensions of largest variance, and stored as Parquet rows that hold a
block of up to ``BLOCK`` neighbours of one label each, with the least and largest entry per dimension:
the zone map, in columns of its own that are read without the vectors.

Interval arithmetic bounds the score of an anchor with any row of a block: each dimension adds between
the lesser and the larger of ``a * least`` and ``a * largest``. Anchors are the stated query set; they are
packed in groups, and each group meets the zone maps in chunks:

1. an anchor's positives can only lie in blocks of its label whose upper bound reaches the score
   that its own block already gives it for that rank;
2. its negatives can only lie in blocks of other labels whose bounds meet one of its windows, from
   80 to 100 percent of a positive's score.

Only pairs of a group and a block that pass become requests; a request is scored as one product of
matrices in a task, which returns the best few rows of each anchor or window, not its scores. Nothing is
gathered by label, anchor or block beyond such a request. How many blocks the bounds rule out is a matter
of the data: clustered vectors leave few, and vectors that point everywhere leave most of them, so that
the work then is that of the query set against all rows.

Defined cases: rows with a null label or vector, with null or non-finite entries, or entries that do not fit
32 bits when scaled, take no part; nor do vectors of another width than most have. Repeated rows are
rows on their own; of equal scores the smaller id comes first and a null id last. Anchors without
a positive or whose windows are empty give no rows, and neither does an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidyshelf.llm.vectors import blob, longs, matrix, runs, usable
from tidyshelf.session import cut, number_rows

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
LOWEST = 80          # percent of the positive's score
#: Rows of a block, anchors of a group, zone maps of a chunk.
BLOCK, GROUP, CHUNK = 1024, 256, 512
#: Dimensions and bits a dimension of the Hilbert key.
CURVE_DIMS, CURVE_BITS = 8, 4
_NULL_ID = np.iinfo(np.int64).max

COLUMNS = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


# -- the curve -------------------------------------------------------------------------------------

def hilbert_keys(cells: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers (0 to 2**bits - 1 in every dimension)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:                    # from the coarsest cell on: reflect and swap axes
        low = level - 1
        for i in range(dims):
            flip = (x[i] & level) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] = np.where(flip, x[i], x[i] ^ swap)
        level >>= 1
    for i in range(1, dims):            # Gray code over the dimensions
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        carry = np.where((x[-1] & level) != 0, carry ^ (level - 1), carry)
        level >>= 1
    x ^= carry
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _moments(rows: DataFrame, width: int) -> np.ndarray:
    """(count, sum, sum of squares, least, largest) per dimension, one row a task and dimension summed."""
    def add(batches):
        total = None
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column("v"), width)
            part = [np.full(width, len(x)), x.sum(0), (x * x).sum(0), x.min(0), x.max(0)]
            total = part if total is None else [
                *(a + b for a, b in zip(total[:3], part[:3])), np.minimum(total[3], part[3]), np.maximum(total[4], part[4])]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), *(
                pa.array(t.astype(float)) for t in total)], ["dim", "n", "s", "q", "lo", "hi"])

    found = rows.select("v").mapInArrow(add, "dim int, n double, s double, q double, lo double, hi double").groupBy(
        "dim").agg(F.sum("n"), F.sum("s"), F.sum("q"), F.min("lo"), F.max("hi")).toPandas().sort_values("dim")
    return found.to_numpy()[:, 1:].T


# -- blocks, anchors, zone maps --------------------------------------------------------------------

def blocks_of(rows: DataFrame, width: int) -> DataFrame:
    """Stored blocks: block, label, rows, lo, hi (zone map), ids, anchor flags, whole entries."""
    n, total, squares, least, largest = _moments(rows, width)
    spread = squares / n - (total / n) ** 2
    dims = np.argsort(-spread, kind="stable")[:CURVE_DIMS]
    low, size = least[dims], np.maximum(largest[dims] - least[dims], 1e-300) / (1 << CURVE_BITS)

    def keyed(batches):
        for batch in batches:
            x = matrix(batch.column("v"), width)
            cells = np.clip(np.floor((x[:, dims] - low) / size), 0, (1 << CURVE_BITS) - 1)
            whole = np.floor(SCALE * x).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("anchor"), pa.array(hilbert_keys(cells)),
                 pa.array([r.tobytes() for r in whole], pa.binary())], ["vec_id", "label", "anchor", "place", "whole"])

    def pack(batches):
        first = TaskContext.get().partitionId() << 24

        def build(run, number):
            whole = np.frombuffer(b"".join(run.column("whole").to_pylist()), np.int32).reshape(-1, width)
            return {"block": first + number, "label": run.column("label")[0].as_py(),
                    "lo": blob(whole.min(axis=0)), "hi": blob(whole.max(axis=0)),
                    "ids": blob(longs(run.column("vec_id"), _NULL_ID)),
                    "anchors": blob(run.column("anchor").to_numpy().astype(bool)), "whole": blob(whole)}
        yield from runs(batches, BLOCK, "label", build)

    ordered = rows.mapInArrow(keyed, "vec_id long, label long, anchor boolean, place long, whole binary") \
        .repartitionByRange("label", "place", "vec_id").sortWithinPartitions("label", "place", "vec_id")
    return cut(ordered.mapInArrow(
        pack, "block long, label long, lo binary, hi binary, ids binary, anchors binary, whole binary"))


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of whole rows; as doubles where those hold every sum exactly."""
    bound = left.shape[1] * float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0))
    if bound < 2 ** 53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T


def anchors_of(blocks: DataFrame, width: int, positives: int = POSITIVES) -> DataFrame:
    """Stored anchors: anchor (a number of its own), vec_id, label, whole, and reach, the score of their
    ``positives``-th best companion in their own block, if it has so many."""
    least = np.iinfo(np.int64).min

    def rows(batches):
        for batch in batches:
            for block, label, ids, flags, whole in zip(*(batch.column(c).to_pylist() for c in (
                    "block", "label", "ids", "anchors", "whole"))):
                at = np.flatnonzero(np.frombuffer(flags, bool))
                if not len(at):
                    continue
                x, ids = np.frombuffer(whole, np.int32).reshape(-1, width), np.frombuffer(ids, np.int64)
                reach = np.full(len(at), least)
                if len(x) > positives:
                    scores = _products(x[at], x)
                    scores[np.arange(len(at)), at] = least
                    reach = -np.partition(-scores, positives - 1, axis=1)[:, positives - 1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(block * BLOCK + at), pa.array(ids[at]), pa.array(np.full(len(at), label)),
                    pa.array([r.tobytes() for r in x[at]], pa.binary()), pa.array(reach)],
                    ["anchor", "vec_id", "label", "whole", "reach"])

    found = blocks.select("block", "label", "ids", "anchors", "whole").mapInArrow(
        rows, "anchor long, vec_id long, label long, whole binary, reach long")
    return cut(found)


def _groups(anchors: DataFrame) -> DataFrame:
    """Anchors of one label in packs; ``windows`` has ``POSITIVES`` scores for each anchor, -1 for none."""
    def pack(batches):
        first = TaskContext.get().partitionId() << 24

        def build(run, number):
            return {"group": first + number, "label": run.column("label")[0].as_py(),
                    "anchors": blob(run.column("anchor").to_numpy()), "reach": blob(run.column("reach").to_numpy()),
                    "windows": b"".join(run.column("windows").to_pylist()), "vectors": b"".join(run.column("whole").to_pylist())}
        yield from runs(batches, GROUP, "label", build)

    ordered = anchors.select("label", "anchor", "reach", "windows", "whole").repartitionByRange(
        "label", "anchor").sortWithinPartitions("label", "anchor")
    return cut(ordered.mapInArrow(pack, "group long, label long, anchors binary, reach binary, windows binary, vectors binary"))


def _zone_chunks(blocks: DataFrame) -> DataFrame:
    """Zone maps of all blocks in numbered packs."""
    def pack(batches):
        first = TaskContext.get().partitionId() << 24

        def build(run, number):
            return {"chunk": first + number, "blocks": blob(run.column("block").to_numpy()),
                    "labels": blob(run.column("label").to_numpy()),
                    "lo": b"".join(run.column("lo").to_pylist()), "hi": b"".join(run.column("hi").to_pylist())}
        yield from runs(batches, CHUNK, None, build)

    packed = cut(blocks.select("block", "label", "lo", "hi").mapInArrow(
        pack, "chunk long, blocks binary, labels binary, lo binary, hi binary"))
    return cut(number_rows(packed, "chunk", "no"))


def _requests(groups: DataFrame, chunks: DataFrame, width: int, same_label: bool) -> DataFrame:
    """(group, block, wanted): the anchors of a group, as flags, that must read a block."""
    def choose(batches):
        for batch in batches:
            for group, label, reach, windows, vectors, blocks, labels, lo, hi in zip(*(
                    batch.column(c).to_pylist() for c in ("group", "label", "reach", "windows", "vectors", "blocks",
                                                          "labels", "lo", "hi"))):
                a = np.frombuffer(vectors, np.int32).reshape(-1, width).astype(np.float64)
                lo, hi = (np.frombuffer(z, np.int32).reshape(-1, width).astype(np.float64) for z in (lo, hi))
                up, down = np.maximum(a, 0), np.minimum(a, 0)
                # Rounding of the sums is covered by a margin that no whole score can notice.
                margin = 1 + 1e-12 * (np.abs(a) @ np.maximum(np.abs(lo), np.abs(hi)).T)
                most = up @ hi.T + down @ lo.T + margin
                if same_label:
                    wanted = most >= np.frombuffer(reach, np.int64)[:, None]
                    wanted &= np.frombuffer(labels, np.int64) == label
                else:
                    fewest = up @ lo.T + down @ hi.T - margin
                    wanted = np.zeros(most.shape, bool)
                    for top in np.frombuffer(windows, np.int64).reshape(len(a), -1).T:
                        wanted |= (top >= 0)[:, None] & (most >= _lowest(top)[:, None]) & (fewest <= top[:, None])
                    wanted &= np.frombuffer(labels, np.int64) != label
                hit = np.flatnonzero(wanted.any(axis=0))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(hit), group)), pa.array(np.frombuffer(blocks, np.int64)[hit]),
                    pa.array([blob(wanted[:, i]) for i in hit], pa.binary())], ["group", "block", "wanted"])

    count = chunks.count()
    spread = groups.where(F.lit(count > 0)).select(
        "group", "label", "reach", "windows", "vectors",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(count - 1, 0)).cast("long"))).alias("no"))
    return cut(spread.join(chunks.withColumnRenamed("labels", "zones"), "no").select(
        "group", "label", "reach", "windows", "vectors", "blocks", F.col("zones").alias("labels"), "lo", "hi",
    ).mapInArrow(choose, "group long, block long, wanted binary"))


def _lowest(top: np.ndarray) -> np.ndarray:
    """Least whole negative score of the window below a positive score."""
    return -((-LOWEST * top) // 100)


# -- scores ----------------------------------------------------------------------------------------

def _best(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` highest scores, ties by smaller id."""
    if len(scores) > count:
        least = -np.partition(-scores, count - 1)[count - 1]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:count]


def _scored(requests: DataFrame, groups: DataFrame, blocks: DataFrame, width: int, negative: bool, count: int) -> DataFrame:
    """Of every request the best ``count`` rows of each anchor (positives: bound 0) or window (its score)."""
    def score(batches):
        for batch in batches:
            for wanted, anchors, windows, vectors, block, ids, whole in zip(*(batch.column(c).to_pylist() for c in (
                    "wanted", "anchors", "windows", "vectors", "block", "ids", "whole"))):
                at = np.flatnonzero(np.frombuffer(wanted, bool))
                anchors = np.frombuffer(anchors, np.int64)[at]
                tops = np.frombuffer(windows, np.int64).reshape(-1, POSITIVES)[at]
                a = np.frombuffer(vectors, np.int32).reshape(-1, width)[at]
                ids, x = np.frombuffer(ids, np.int64), np.frombuffer(whole, np.int32).reshape(-1, width)
                out: list[tuple[np.ndarray, ...]] = []
                for anchor, top, scores in zip(anchors.tolist(), tops, _products(a, x)):
                    if negative:
                        tried = np.unique(top[top >= 0])
                        own = [(t, np.flatnonzero((scores <= t) & (scores >= low)))
                               for t, low in zip(tried.tolist(), _lowest(tried).tolist())]
                    else:
                        mine = anchor - block * BLOCK
                        rest = np.arange(len(x))
                        own = [(0, rest[rest != mine] if 0 <= mine < len(x) else rest)]
                    for bound, rows in own:
                        rows = rows[_best(scores[rows], ids[rows], count)]
                        out.append((np.full(len(rows), anchor), np.full(len(rows), bound), scores[rows], ids[rows]))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c)) for c in zip(*out)], ["anchor", "bound", "score", "id"])

    asked = requests.join(groups.select("group", "anchors", "windows", "vectors"), "group")
    return asked.join(blocks.select("block", "ids", "whole"), "block").select(
        "wanted", "anchors", "windows", "vectors", "block", "ids", "whole").mapInArrow(
        score, "anchor long, bound long, score long, id long")


def _first(rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, vector: str = "embedding") -> DataFrame:
    """For each anchor and positive the best rows of other labels in the positive's window."""
    if positives > POSITIVES:
        raise ValueError(f"at most {POSITIVES} positives")
    rows, width = usable(vectors.select(
        F.col("vec_id").cast("long"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.col(vector).alias("v")).where("label IS NOT NULL"), "v", 2.0 ** 31 / SCALE - 1)
    if not width:
        return vectors.sparkSession.createDataFrame([], COLUMNS)
    blocks = blocks_of(rows, width)
    chunks = _zone_chunks(blocks)
    anchors = anchors_of(blocks, width, positives)
    no_windows = F.lit(np.full(POSITIVES, -1, np.int64).tobytes())
    groups = _groups(anchors.withColumn("windows", no_windows))
    asked = _requests(groups, chunks, width, same_label=True)
    best = cut(_first(_scored(asked, groups, blocks, width, False, positives), ["anchor"], positives)
               .select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"),
                       F.col("score").alias("positive_score")))

    def windows(batches):
        for batch in batches:
            tops = np.full((len(batch), POSITIVES), -1, np.int64)
            for i, scores in enumerate(batch.column("scores").to_pylist()):
                tops[i, :len(scores)] = scores
            yield pa.RecordBatch.from_arrays([batch.column("anchor"), pa.array([t.tobytes() for t in tops], pa.binary())],
                                             ["anchor", "windows"])

    tops = best.groupBy("anchor").agg(F.collect_list("positive_score").alias("scores")).mapInArrow(
        windows, "anchor long, windows binary")
    groups = _groups(anchors.join(tops, "anchor"))
    asked = _requests(groups, chunks, width, same_label=False)
    found = _first(_scored(asked, groups, blocks, width, True, negatives), ["anchor", "bound"], negatives)
    no_null = lambda c: F.nullif(F.col(c), F.lit(int(_NULL_ID)))
    return (best.join(anchors.select("anchor", "vec_id"), "anchor")
            .join(found.select("anchor", F.col("bound").alias("positive_score"), "rank",
                               F.col("id").alias("negative_id"), F.col("score").alias("negative_score")),
                  ["anchor", "positive_score"])
            .select(no_null("vec_id").alias("anchor_id"), no_null("positive_id").alias("positive_id"), "rank",
                    no_null("negative_id").alias("negative_id"), "positive_score", "negative_score"))
