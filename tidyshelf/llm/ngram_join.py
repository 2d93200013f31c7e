"""Exact Jaccard join of word n-gram sets that skips by relations between sets.

Texts with equal sets are one class from the start. Classes whose sets agree in three independent minima
are taken to be highly similar: they form a relation, known by its least class. Two mechanisms spare work:

* **Index level.** A set indexes only its prefix in one global order (rare hash buckets first), and an
  index list has one entry for each relation, not one for each set, with the range of sizes and the
  best position of its sets. Long lists are kept by falling position in blocks; a block whose best
  position or sizes cannot reach the threshold is skipped whole.
* **Answer level.** Of two relations that meet in the index, only one pair of sets is intersected in
  full. Every other answer is derived from it by the differences: with ``S = R + dS`` and ``T = Q + dT``
  (entries 1 for an added n-gram and -1 for a missing one) ``|S & T| = |R & Q| + dS.Q + R.dT + dS.dT``, and the
  last term is a product of sparse matrices over the n-grams that both sides change. The answers
  within a relation come about in the same way.

Relations that are not similar at all would only cost time: each answer is exact either way, so no link is
lost or invented. Members of a relation are stored in bounded blocks, and each pair of blocks is a row of its
own, so no task holds a relation. A block is compared with itself as it is packed, and keeps the root of each set
among its own links. It holds its n-grams once, and of each set but the first what it changes (or, if that is
less, what it has). A pair of blocks gives back numbers of links, added up within a task, and a spanning forest
over the roots of both, never the pairs: a group of near copies has one edge a pair of blocks.

Between the two, pairs of small relations are held against sketches, of a few bits an n-gram, that bound an
intersection from above: a set's sketch has a bit for each hash value that an odd number of its n-grams
has, and no bit in which two sketches differ can come from a shared n-gram.

Sets and n-grams are known by 64-bit hashes. Defined cases: a null or blank text has an empty set and
links with nothing; a text of fewer words is one n-gram; equal texts link with each other; rows with a
null id count as links, and a component without any id is null; an empty table gives no rows.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidyshelf.llm import frames
from tidyshelf.llm.components import components
from tidyshelf.session import cut

WIDTH, LEAST = 5, 80
#: Hash buckets whose counts order the n-grams; fixed by design.
BUCKETS = 1 << 16
#: Sets of a block, and bytes of it; entries of a list's block; columns of one product.
BLOCK, BLOCK_BYTES, LIST_BLOCK, COLUMNS_AT_ONCE = 512, 4 << 20, 64, 512
#: Blocks that a copy of a block meets.
MET = 64
#: Members of a relation whose pairs are sieved by sketches.
SMALL = 16
#: Classes a task remembers, so that the copies it meets are passed on once.
REMEMBERED = 1 << 16
#: Bits of the filter of classes that need their sets.
FILTER_BITS = 1 << 21

_RUN = np.uint64(0x9E3779B97F4A7C15)
_MINIMA = tuple(np.uint64(m) for m in (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_LOW48 = np.uint64((1 << 48) - 1)


# -- sets ------------------------------------------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the word n-grams, rising."""
    words = text.lower().split()
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    count = max(len(hashes) - width + 1, min(len(hashes), 1))
    keys = np.zeros(count, np.uint64)
    for i in range(min(width, len(hashes))):
        keys = _mixed(keys * _RUN + hashes[i:i + count])
    return np.unique(keys)


def class_of(grams: np.ndarray) -> int:
    """Number of the set, equal for equal sets."""
    whole = np.array([_mixed(grams ^ _RUN).sum(dtype=np.uint64), len(grams)], np.uint64)
    return int(_mixed(whole[:1] + _mixed(whole[1:]))[0].astype(np.int64)) if len(grams) else 0


def relation_of(grams: np.ndarray) -> int:
    """Key of three minima."""
    least = np.array([(grams * m).min() for m in _MINIMA], np.uint64)
    return int(_mixed(least[:1] + _mixed(least[1:2] + _mixed(least[2:])))[0].astype(np.int64))


def sketch(grams: np.ndarray) -> bytes:
    """Parities of the n-grams by hash value, at two to four bits an n-gram."""
    size = max(64, 1 << (2 * len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def most_shared(n_a: int, a: bytes, n_b: int, b: bytes) -> int:
    """Upper bound of an intersection by the two sketches; the longer one is folded to the other's size."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return (n_a + n_b - int(np.bitwise_count(x ^ y).sum())) // 2


def _sets(batches, width: int):
    for part in frames.slices(batches):
        ids = part.column("doc_id") if "doc_id" in part.schema.names else None
        yield ids, [ngram_set(t, width) for t in frames.encoded(part.column("text"))]


def profile(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Stored rows of two kinds: (doc_id, cid, n, relation, sketch) of every text, and (bucket, count)."""
    def rows(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for ids, sets in _sets(batches, width):
            if not sets:
                continue
            counts += np.bincount((np.concatenate(sets) >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
            yield pa.RecordBatch.from_arrays([
                ids, pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([relation_of(s) if len(s) else 0 for s in sets], pa.int64()),
                pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.int64())], names)
        used = np.flatnonzero(counts)
        empty = [*[pa.nulls(len(used), pa.int64())] * 4, pa.nulls(len(used), pa.binary())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(used.astype(np.int32)), pa.array(counts[used])], names)

    names = ["doc_id", "cid", "n", "relation", "sketch", "bucket", "count"]
    return cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        rows, "doc_id long, cid long, n long, relation long, sketch binary, bucket int, count long"))


def bucket_ranks(profiled: DataFrame) -> np.ndarray:
    """Place of each bucket when the rare ones come first."""
    found = profiled.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("count").alias("n")).toPandas()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy()
    ranks = np.empty(BUCKETS, np.uint16)
    ranks[np.argsort(counts, kind="stable")] = np.arange(BUCKETS, dtype=np.uint16)
    return ranks


def in_order(grams: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The n-grams renamed, one to one, so that they sort in the global order; sorted."""
    return np.sort((ranks[(grams >> np.uint64(48)).astype(np.int64)].astype(np.uint64) << np.uint64(48))
                   | (grams & _LOW48))


def prefix_length(n: int, least: int = LEAST) -> int:
    return n - (least * n + 99) // 100 + 1


def classes_of(profiled: DataFrame) -> DataFrame:
    """Stored classes of non-empty sets: cid, n, copies, least_doc, leader, members of the relation."""
    classes = profiled.where("bucket IS NULL AND n > 0").groupBy("cid").agg(
        F.max("n").alias("n"), F.max("relation").alias("relation"), F.count(F.lit(1)).alias("copies"),
        F.min("doc_id").alias("least_doc"))
    classes = cut(classes)
    leaders = classes.groupBy("relation").agg(F.min("cid").alias("leader"), F.count(F.lit(1)).alias("members"))
    return cut(classes.join(leaders, "relation").drop("relation"))


class _Once:
    """Whether a class is new to this task, as far as it remembers."""

    def __init__(self):
        self.seen: OrderedDict[int, None] = OrderedDict()

    def new(self, cid: int) -> bool:
        if cid in self.seen:
            self.seen.move_to_end(cid)
            return False
        self.seen[cid] = None
        if len(self.seen) > REMEMBERED:
            self.seen.popitem(last=False)
        return True


# -- index -----------------------------------------------------------------------------------------

def shared_entries(docs: DataFrame, ranks: np.ndarray, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """Stored index entries (gram, cid, n, rest) of prefixes, without n-grams of one class only.

    ``rest`` is the number of the set's n-grams from this one on."""
    def entries(batches):
        once = _Once()
        for _, sets in _sets(batches, width):
            out = []
            for grams in sets:
                if len(grams) and once.new(cid := class_of(grams)):
                    n = len(grams)
                    head = in_order(grams, ranks)[:prefix_length(n, least)]
                    out.append((head.view(np.int64), np.full(len(head), cid),
                                (n << 32) | (n - np.arange(len(head), dtype=np.int64))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["gram", "cid", "at"])

    def shared(batches):
        held = np.zeros((3, 0), np.int64)     # the last row, which may have a partner in the next batch
        matched = False
        for batch in batches:
            rows = np.concatenate([held, np.array([batch.column(c).to_numpy() for c in ("gram", "cid", "at")])], axis=1)
            fresh = np.ones(rows.shape[1], bool)
            fresh[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
            rows = rows[:, fresh]
            if not rows.shape[1]:
                continue
            same = rows[0, 1:] == rows[0, :-1]
            keep = np.zeros(rows.shape[1], bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= matched and held.shape[1] > 0
            held, matched, out = rows[:, -1:], bool(keep[-1]), rows[:, :-1][:, keep[:-1]]
            if out.shape[1]:
                yield _entry_batch(out)
        if matched:
            yield _entry_batch(held)

    sorted_entries = docs.select("text").mapInArrow(entries, "gram long, cid long, at long").repartition(
        "gram").sortWithinPartitions("gram", "cid")
    return cut(sorted_entries.mapInArrow(shared, "gram long, cid long, n long, rest long"))


def _entry_batch(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2] >> 32),
                                       pa.array(rows[2] & 0xFFFFFFFF)], ["gram", "cid", "n", "rest"])


def _may_link(small_a, large_a, rest_a, small_b, large_b, rest_b, least: int) -> np.ndarray:
    """Whether entries with these ranges of sizes and best rests may hold a linked pair that meets here first."""
    return ((100 * large_a >= least * small_b) & (100 * large_b >= least * small_a)
            & ((100 + least) * np.minimum(rest_a, rest_b) >= least * (small_a + small_b)))


def list_pairs(leader: np.ndarray, small: np.ndarray, large: np.ndarray, rest: np.ndarray,
               least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one list, given by falling rest, that pass the filters; whole blocks are skipped."""
    starts = np.arange(0, len(leader), LIST_BLOCK)
    block = (np.minimum.reduceat(small, starts), np.maximum.reduceat(large, starts), rest[starts])
    left, right = [], []
    for k, start in enumerate(starts.tolist()):
        near = k + np.flatnonzero(_may_link(*(b[k] for b in block), *(b[k:] for b in block), least))
        for other in near.tolist():
            i = np.arange(start, min(start + LIST_BLOCK, len(leader)))[:, None]
            j = np.arange(starts[other], min(starts[other] + LIST_BLOCK, len(leader)))[None, :]
            hit = (i < j) & _may_link(small[i], large[i], rest[i], small[j], large[j], rest[j], least)
            at = np.nonzero(hit)
            left.append(leader[i[at[0], 0]])
            right.append(leader[j[0, at[1]]])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def related_pairs(entries: DataFrame, classes: DataFrame, least: int = LEAST) -> DataFrame:
    """Stored pairs (a, b) of different relations that meet in the index."""
    def pairs(batches):
        held = None
        for batch in batches:
            rows = np.array([batch.column(c).to_numpy() for c in ("gram", "leader", "small", "large", "rest")])
            rows = rows if held is None else np.concatenate([held, rows], axis=1)
            edge = int(np.searchsorted(rows[0], rows[0, -1]))
            held = rows[:, edge:]
            yield from found(rows[:, :edge])
        if held is not None:
            yield from found(held)

    def found(rows):
        gram, values = rows[0], rows[1:]
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, int)
        sizes = np.diff(np.concatenate([starts, [len(gram)]]))
        out = [np.zeros((2, 0), np.int64)]
        short = np.repeat(sizes <= LIST_BLOCK, sizes)
        for step in range(1, min(LIST_BLOCK, int(sizes.max(initial=0)))):
            i = np.flatnonzero(short[:-step] & (gram[step:] == gram[:-step]))
            i = i[_may_link(*values[1:, i], *values[1:, i + step], least)]
            out.append(values[0][np.array([i, i + step])])
        for start, size in zip(starts[sizes > LIST_BLOCK].tolist(), sizes[sizes > LIST_BLOCK].tolist()):
            out.append(np.array(list_pairs(*values[:, start:start + size], least)))
        ends = np.sort(np.concatenate(out, axis=1), axis=0)
        ends = np.unique(ends[:, ends[0] != ends[1]], axis=1)
        if ends.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], ["a", "b"])

    lists = entries.join(classes.select("cid", "leader"), "cid").repartition("gram").groupBy("gram", "leader").agg(
        F.min("n").alias("small"), F.max("n").alias("large"), F.max("rest").alias("rest"))
    return cut(lists.sortWithinPartitions("gram", F.desc("rest"), "leader").mapInArrow(
        pairs, "a long, b long").distinct())


def sieved(pairs: DataFrame, classes: DataFrame, profiled: DataFrame, least: int = LEAST) -> DataFrame:
    """Stored pairs without those of small relations in which no two sketches allow a link."""
    asked = pairs.select(F.col("a").alias("leader")).unionByName(pairs.select(F.col("b").alias("leader"))).distinct()
    small = classes.where(F.col("members") <= SMALL).select("cid", "leader").join(asked, "leader", "left_semi")
    known = profiled.where("bucket IS NULL AND n > 0").select("cid", F.struct("n", "sketch").alias("one")).join(
        small, "cid").groupBy("leader", "cid").agg(F.first("one").alias("one")).groupBy("leader").agg(
        F.collect_list("one").alias("sketches"))

    def keep(batches):
        for batch in batches:
            out = []
            for a, b, left, right in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "left", "right"))):
                if left is None or right is None or any(
                        (100 + least) * most_shared(x["n"], x["sketch"], y["n"], y["sketch"]) >= least * (x["n"] + y["n"])
                        for x in left for y in right):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    both = pairs.join(known.select(F.col("leader").alias("a"), F.col("sketches").alias("left")), "a", "left").join(
        known.select(F.col("leader").alias("b"), F.col("sketches").alias("right")), "b", "left")
    return cut(both.select("a", "b", "left", "right").mapInArrow(keep, "a long, b long"))


# -- answers ---------------------------------------------------------------------------------------

def pack_sets(sets: list[np.ndarray]) -> tuple[bytes, bytes, bytes]:
    """Sets of a block as its n-grams, those of the first set in front; how many places each other set names, negative
    if they are all its own and not those in which it differs from the first; and the places."""
    first, others = sets[0], sets[1:]
    grams = np.concatenate([first, np.setdiff1d(np.concatenate(others), first)]) if others else first
    order, own = np.argsort(grams), np.arange(len(first))
    counts, places = [], [own[:0]]
    for one in others:
        at = order[np.searchsorted(grams, one, sorter=order)]
        apart = np.setxor1d(at, own, assume_unique=True)
        near = len(apart) < len(at)
        counts.append(len(apart) if near else -len(at))
        places.append(apart if near else at)
    return grams.tobytes(), np.array(counts, np.int32).tobytes(), np.concatenate(places).astype(_place(grams)).tobytes()


def unpack_sets(first: int, grams: bytes, counts: bytes, places: bytes) -> list[np.ndarray]:
    """The sets of ``pack_sets``, each rising; ``first`` is the size of the first one."""
    known, named = np.frombuffer(grams, np.uint64), np.frombuffer(counts, np.int32)
    at = np.split(np.frombuffer(places, _place(known)), np.cumsum(np.abs(named)))
    out = [known[:first]]
    for count, some in zip(named.tolist(), at):
        mask = np.zeros(len(known), bool)
        mask[:first] = count >= 0
        mask[some] ^= True
        out.append(np.sort(known[mask]))
    return out


def _place(grams: np.ndarray) -> type:
    return np.uint16 if len(grams) <= 1 << 16 else np.uint32


def member_blocks(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int = WIDTH,
                  least: int = LEAST) -> DataFrame:
    """Stored blocks of the relations in question: block, leader, cids, copies, sizes, the sets packed, and
    of the links within the block their number and the root (a place in the block)."""
    asked = pairs.select(F.col("a").alias("leader")).unionByName(pairs.select(F.col("b").alias("leader"))).distinct()
    needed = cut(classes.where("members > 1").unionByName(
        classes.where("members = 1").join(asked, "leader", "left_semi").select(*classes.columns)))
    bit = F.pmod("cid", F.lit(FILTER_BITS)).cast("int")
    bits = np.zeros(FILTER_BITS, bool)
    if needed.count() <= FILTER_BITS // 4:
        bits[needed.select(bit.alias("bit")).distinct().toPandas()["bit"].to_numpy(np.int64)] = True
    else:
        bits[:] = True
    packed = np.packbits(bits)

    def wanted_sets(batches):
        once, bits = _Once(), np.unpackbits(packed)
        for _, sets in _sets(batches, width):
            known = [(class_of(s), s) for s in sets if len(s)]
            out = [(c, s) for c, s in known if bits[c % FILTER_BITS] and once.new(c)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()),
                                                  pa.array([s.tobytes() for _, s in out], pa.binary())], ["cid", "grams"])

    def pack(batches):
        first, number = TaskContext.get().partitionId() << 24, 0
        held, size, last = [], 0, None

        def block():
            copies = np.array([h[2] for h in held], np.int64)
            sizes = np.array([len(h[3]) // 8 for h in held], np.int64)
            links = np.zeros((len(held), len(held)), bool)
            own = [np.frombuffer(h[3], np.uint64) for h in held]
            grams, counts, places = pack_sets(own)
            if len(held) > 1:
                links = (100 + least) * overlaps(own, own) >= least * (sizes[:, None] + sizes[None, :])
                np.fill_diagonal(links, False)
            return pa.RecordBatch.from_pylist([{
                "block": first + number, "leader": held[0][0], "cids": np.array([h[1] for h in held], np.int64).tobytes(),
                "copies": copies.tobytes(), "sizes": sizes.tobytes(), "links": (links @ copies).tobytes(),
                "roots": roots(links).tobytes(), "grams": grams, "counts": counts, "places": places}])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("leader", "cid", "copies", "grams"))):
                if row[1] == last:
                    continue
                last = row[1]
                if held and (row[0] != held[0][0] or len(held) == BLOCK or size + len(row[3]) > BLOCK_BYTES):
                    yield block()
                    held, size, number = [], 0, number + 1
                held.append(row)
                size += len(row[3])
        if held:
            yield block()

    sets = docs.select("text").mapInArrow(wanted_sets, "cid long, grams binary")
    part = F.pmod(F.xxhash64("cid"), F.ceil(F.col("members") / BLOCK)).alias("part")
    dealt = sets.join(needed.select("cid", "leader", "copies", part), "cid").repartition("leader", "part")
    return cut(dealt.sortWithinPartitions("leader", "part", "cid").select("leader", "cid", "copies", "grams").mapInArrow(
        pack, "block long, leader long, cids binary, copies binary, sizes binary, links binary, roots binary, "
        "grams binary, counts binary, places binary"))


def _signed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram, set, sign) of what each set has more or less than the first."""
    grams, owner, sign = [], [], []
    for k, own in enumerate(sets[1:], 1):
        apart = np.setxor1d(own, sets[0], assume_unique=True)
        grams.append(apart)
        owner.append(np.full(len(apart), k))
        sign.append(np.where(np.isin(apart, sets[0], assume_unique=True), -1, 1))
    none = np.zeros(0, np.int64)
    return (np.concatenate(grams), np.concatenate(owner), np.concatenate(sign)) if grams else (
        np.zeros(0, np.uint64), none, none)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of each set of one block with each of the other: the first two are
    intersected, all others follow from the differences."""
    first, other = left[0], right[0]
    base = len(np.intersect1d(first, other, assume_unique=True))
    (ga, oa, sa), (gb, ob, sb) = _signed(left), _signed(right)
    out = np.full((len(left), len(right)), base, np.int64)
    out += np.bincount(oa, sa * np.isin(ga, other), len(left)).astype(np.int64)[:, None]
    out += np.bincount(ob, sb * np.isin(gb, first), len(right)).astype(np.int64)[None, :]
    common = np.intersect1d(ga, gb)
    for at in range(0, len(common), COLUMNS_AT_ONCE):
        some = common[at:at + COLUMNS_AT_ONCE]
        sides = []
        for grams, owner, sign, count in ((ga, oa, sa, len(left)), (gb, ob, sb, len(right))):
            column = np.minimum(np.searchsorted(some, grams), len(some) - 1)
            hit = some[column] == grams
            side = np.zeros((count, len(some)), np.float32)
            side[owner[hit], column[hit]] = sign[hit]
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that connect what the matrix of links connects."""
    edges, rows, columns = [], np.zeros(len(links), bool), np.zeros(links.shape[1], bool)
    for start in np.flatnonzero(links.any(axis=1)).tolist():
        if rows[start]:
            continue
        rows[start] = True
        front = np.array([start])
        while len(front):
            own = links[front]
            new = np.flatnonzero(own.any(axis=0) & ~columns)
            edges += zip(front[own[:, new].argmax(axis=0)].tolist(), new.tolist())
            columns[new] = True
            back = links[:, new]
            front = np.flatnonzero(back.any(axis=1) & ~rows)
            edges += zip(front.tolist(), new[back[front].argmax(axis=1)].tolist()) if len(front) else []
            rows[front] = True
    return edges


def roots(links: np.ndarray) -> np.ndarray:
    """The first row that each row is connected with, of a symmetric matrix of links."""
    out = np.full(len(links), -1, np.int64)
    for start in range(len(links)):
        front = np.array([start]) if out[start] < 0 else np.zeros(0, int)
        while len(front):
            out[front] = start
            front = np.flatnonzero(links[front].any(axis=0) & (out < 0))
    return out


def root_edges(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) between roots that connect what the links of two blocks connect."""
    a, i = np.unique(left, return_inverse=True)
    b, j = np.unique(right, return_inverse=True)
    met = np.zeros((len(a), len(b)), bool)
    row, column = np.nonzero(links)
    met[i[row], j[column]] = True
    return [(int(a[x]), int(b[y])) for x, y in forest(met)]


def block_pairs(blocks: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored pairs (x, y, part) of blocks to compare, and (y, parts): the smaller block x is sent to the larger, which
    is repeated once for some ``MET`` of the blocks it meets and not for each of them."""
    where = blocks.select("leader", "block", (F.length("grams") + F.length("places")).alias("size"))
    x, y = where.toDF("a", "x", "p"), where.toDF("b", "y", "q")
    both = pairs.join(x, "a").join(y, "b").select("x", "p", "y", "q").unionByName(
        x.join(where.toDF("a", "y", "q"), "a").where("x < y").select("x", "p", "y", "q"))
    swap = F.col("p") > F.col("q")
    met = cut(both.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"),
                          F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y")))
    parts = cut(met.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / MET).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("part")
    return met.join(parts, "y").select("x", "y", part), parts


def answers(blocks: DataFrame, pairs: DataFrame, least: int = LEAST) -> DataFrame:
    """Stored rows (cid, links, other): numbers of links found, and edges that connect what they connect."""
    tiles, parts = block_pairs(blocks, pairs)
    side = lambda s: blocks.select(F.col("block").alias(s), *[
        F.col(c).alias(f"{s}_{c}") for c in ("cids", "copies", "sizes", "roots", "grams", "counts", "places")])

    def within(batches):
        for batch in batches:
            out = [np.zeros((3, 0), np.int64)]
            for row in zip(*(batch.column(c).to_pylist() for c in ("cids", "links", "roots"))):
                cids, links, root = (np.frombuffer(v, np.int64) for v in row)
                out.append(np.array([cids, links, cids[root]])[:, links > 0])
            rows = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["cid", "links", "other"])

    def numbers(total):
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64()),
                                           pa.nulls(len(total), pa.int64())], ["cid", "links", "other"])

    def score(batches):
        total: dict[int, int] = {}
        for batch in batches:
            edges = []
            for row in batch.to_pylist():
                n, cids, copies, root = ([np.frombuffer(row[f"{s}_{c}"], np.int64) for s in "xy"]
                                         for c in ("sizes", "cids", "copies", "roots"))
                inter = overlaps(*(unpack_sets(int(n[i][0]), *(row[f"{s}_{c}"] for c in ("grams", "counts", "places")))
                                   for i, s in enumerate("xy")))
                links = (100 + least) * inter >= least * (n[0][:, None] + n[1][None, :])
                for own, found in ((cids[0], links @ copies[1]), (cids[1], copies[0] @ links)):
                    some = found > 0
                    for cid, more in zip(own[some].tolist(), found[some].tolist()):
                        total[cid] = total.get(cid, 0) + more
                edges += [(cids[0][i], 0, cids[1][j]) for i, j in root_edges(links, *root)]
                if len(total) > REMEMBERED:
                    yield numbers(total)
                    total = {}
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*edges)], ["cid", "links", "other"])
        if total:
            yield numbers(total)

    shape = "cid long, links long, other long"
    repeated = side("y").join(parts, "y").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    joined = tiles.join(side("x"), "x").join(repeated, ["y", "part"])
    return cut(joined.mapInArrow(score, shape).unionByName(
        blocks.select("cids", "links", "roots").mapInArrow(within, shape)))


def jaccard_join(docs: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row: size of its set, smallest id reachable by
    links, and number of other rows linked with it. ``least`` is the similarity in percent."""
    profiled = profile(docs, width)
    classes = classes_of(profiled)
    entries = shared_entries(docs, bucket_ranks(profiled), width, least)
    pairs = sieved(related_pairs(entries, classes, least), classes, profiled, least)
    found = answers(member_blocks(docs, classes, pairs, width, least), pairs, least)
    edges = found.where("other IS NOT NULL").select(F.col("cid").alias("a"), F.col("other").alias("b"))
    groups = components(edges).withColumnRenamed("node", "cid")
    degrees = found.groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.select("cid", "copies", "least_doc").join(degrees, "cid", "left").join(groups, "cid", "left").select(
        "cid", "copies", "least_doc", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cid").alias("component"))
    known = cut(known)
    firsts = known.groupBy("component").agg(F.min("least_doc").alias("component_id"))
    results = known.join(firsts, "component").select(
        "cid", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    rows = profiled.where("bucket IS NULL").select("doc_id", "n", F.when(F.col("n") > 0, F.col("cid")).alias("cid"))
    linked = rows.where("cid IS NOT NULL").join(results, "cid").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    return linked.unionByName(rows.where("cid IS NULL").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
