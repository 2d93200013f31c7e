"""SimHash near-duplicates: fingerprints in shards of a vantage-point tree.

A fingerprint's bit is the majority over the XXH64 values of a text's word shingles. Equal
fingerprints are one point. A tree of vantage points, chosen from a bounded sample, deals the points
out: at each node a point lies inside or outside the median distance of the sample, and it is also
sent as a query to the other side when the triangle bound allows a partner there, that is when its
distance is within ``bits`` of the radius. Each shard holds its own points once and the queries whose
ball overlaps it; inside a shard the same tree goes on in numpy, and its leaves compare all that is
left. So each linked pair is found in the home shard of one of the two, with no recall lost.

A shard returns a spanning forest of its links instead of all pairs, so a group of thousands of near
copies costs as many edges as it has members; components of the forests give the groups.

Cost: a ball of radius 3 overlaps both sides of a median split of random 64-bit values in about 6 of
10 cases, so comparisons grow with about the 1.7th power of the number of different fingerprints,
and a point goes to about ``1.6 ** depth`` shards.

Defined cases: a null or blank text has fingerprint 0 and links like any other; texts of fewer words
than a shingle hash the whole sequence; equal rows share everything; a row with a null id belongs to
the group of its fingerprint, and is alone (null group) where no row with that fingerprint has an id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidyshelf.llm import frames
from tidyshelf.llm.components import components
from tidyshelf.session import cut

SHINGLE, BITS, SEED = 3, 3, 42
#: Points of a shard that the tree aims at, and points sampled for each shard of the tree.
SHARD, SAMPLE = 16_384, 64
#: Most shards a tree may have; its nodes are what the tasks get.
MOST_SHARDS = 4_096
#: Points and queries of a task; a shard with more is a grid of such blocks.
HOME_BLOCK, QUERY_BLOCK = 1 << 16, 1 << 20
#: Comparisons at which a numpy node stops to split.
LEAF = 1 << 18


# -- fingerprints ----------------------------------------------------------------------------------

def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[:len(words) - width + 1].tolist()
    stops = (ends[width - 1:] - 1).tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)], ">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed 64-bit number."""
    def rows(batches):
        for part in frames.slices(batches):
            values = np.array([fingerprint(t, width) for t in frames.encoded(part.column("text"))],
                              np.uint64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, fp long")


# -- the tree --------------------------------------------------------------------------------------

def distance(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int64)


def vantage_tree(sample: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """(vantage point, radius) of the nodes in heap order: node i has children 2 i + 1 (distance up to
    the radius) and 2 i + 2. The vantage point of a node is the one of a few that spreads best."""
    nodes: list[tuple[int, int]] = []
    members = [sample]
    for _ in range(depth):
        below = []
        for own in members:
            tried = own[np.linspace(0, len(own) - 1, min(len(own), 16)).astype(int)] if len(own) \
                else np.zeros(1, np.uint64)
            vantage = max(tried.tolist(), key=lambda v: (distance(own, v).var() if len(own) else 0, v))
            far = distance(own, vantage)
            radius = int(np.median(far)) if len(own) else 32
            nodes.append((vantage, radius))
            below += [own[far <= radius], own[far > radius]]
        members = below
    return nodes


def route(points: np.ndarray, nodes: list[tuple[int, int]], depth: int, bits: int):
    """(index of point, shard, whether at home) for every shard that the ball of each point overlaps."""
    at = [(np.arange(len(points)), np.ones(len(points), bool), 0)]
    for _ in range(depth):
        below = []
        for rows, home, node in at:
            vantage, radius = nodes[node]
            far = distance(points[rows], vantage)
            inside = far <= radius
            a, b = far <= radius + bits, far > radius - bits
            below += [(rows[a], home[a] & inside[a], 2 * node + 1),
                      (rows[b], home[b] & ~inside[b], 2 * node + 2)]
        at = [x for x in below if len(x[0])]
    first = (1 << depth) - 1
    return (np.concatenate([x[0] for x in at]) if at else np.zeros(0, np.int64),
            np.concatenate([np.full(len(x[0]), x[2] - first) for x in at]) if at
            else np.zeros(0, np.int64),
            np.concatenate([x[1] for x in at]) if at else np.zeros(0, bool))


class Forest:
    """Union-find over the points of a shard; keeps the edges that joined two trees."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    def roots(self) -> np.ndarray:
        """The root of every point."""
        parent = self.parent
        while True:
            above = parent[parent]
            if (above == parent).all():
                return parent
            self.parent = parent = above

    def link(self, pairs: np.ndarray) -> None:
        """Joins the trees of each pair; pairs inside one tree are passed over in bulk."""
        _, first = np.unique(pairs[:, 0], return_index=True)
        for some in (pairs[first], pairs):
            roots = self.roots()
            ends = np.sort(roots[some], axis=1)
            _, keep = np.unique(ends, axis=0, return_index=True)
            keep = keep[ends[keep, 0] != ends[keep, 1]]
            for a, b in some[keep].tolist():
                x, y = self.root(a), self.root(b)
                if x != y:
                    self.parent[max(x, y)] = min(x, y)
                    self.edges.append((a, b))


def search(points: np.ndarray, own: np.ndarray, asked: np.ndarray, bits: int, forest: Forest) -> None:
    """Links every pair of one of ``own`` and one of ``asked`` (indices into ``points``) that differ in
    at most ``bits`` bits. Queries go down both branches of a node only where their ball reaches."""
    todo = [(own, asked)]
    while todo:
        own, asked = todo.pop()
        if not len(own) or not len(asked):
            continue
        if len(own) * len(asked) > LEAF and len(own) > 32:
            tried = points[own[np.linspace(0, len(own) - 1, 4).astype(int)]].tolist()
            vantage = max(tried, key=lambda v: distance(points[own], v).var())
            far = distance(points[own], vantage)
            radius = int(np.median(far))
            inside = far <= radius
            if 0 < inside.sum() < len(own):
                reach = distance(points[asked], vantage)
                todo += [(own[inside], asked[reach <= radius + bits]),
                         (own[~inside], asked[reach > radius - bits])]
                continue
        step = max(1, LEAF // len(own))
        for at in range(0, len(asked), step):
            q = asked[at:at + step]
            near = np.bitwise_count(points[q][:, None] ^ points[own][None, :]) <= bits
            i, j = np.nonzero(near)
            pairs = np.stack([q[i], own[j]], axis=1)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            if len(pairs):
                forest.link(pairs)


def links(points: DataFrame, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """Spanning links (a, b) between the ids of points (node long, fp long; one row per fp) whose
    fingerprints differ in at most ``bits`` bits."""
    spark = points.sparkSession
    n = points.count()
    depth = 0
    while shard << depth < n and 1 << depth < MOST_SHARDS:
        depth += 1
    take = SAMPLE << depth
    sample = points.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(max(n, 1))) < take).orderBy(
        "fp").select("fp").toPandas()
    nodes = vantage_tree(sample["fp"].to_numpy(np.int64).view(np.uint64), depth)
    tree = spark.sparkContext.broadcast(nodes)

    def count(batches):
        sizes = np.zeros((2, 1 << depth), np.int64)
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            _, shards, home = route(fps, tree.value, depth, bits)
            sizes[0] += np.bincount(shards[home], minlength=1 << depth)
            sizes[1] += np.bincount(shards, minlength=1 << depth)
        used = np.flatnonzero(sizes[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(sizes[0][used]), pa.array(sizes[1][used])],
            ["shard", "home", "asked"])

    points = points.select("node", "fp")
    sizes = points.mapInArrow(count, "shard long, home long, asked long").groupBy("shard").agg(
        F.sum("home").alias("home"), F.sum("asked").alias("asked")).toPandas()
    blocks = np.ones((2, 1 << depth), np.int64)
    blocks[0][sizes["shard"]] = (-(-sizes["home"] // HOME_BLOCK)).clip(lower=1)
    blocks[1][sizes["shard"]] = (-(-sizes["asked"] // QUERY_BLOCK)).clip(lower=1)

    def deal(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            ids = batch.column("node").to_numpy(zero_copy_only=False)
            rows, shards, home = route(fps, tree.value, depth, bits)
            mixed = (fps[rows] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            own, ask = (b[shards] for b in blocks)
            place = (mixed % own.astype(np.uint64)).astype(np.int64), \
                (mixed % ask.astype(np.uint64)).astype(np.int64)
            for is_home, chosen, copies in ((True, home, ask), (False, np.ones_like(home), own)):
                i = np.repeat(np.flatnonzero(chosen), copies[chosen])
                ends = np.cumsum(copies[chosen])
                k = np.arange(len(i)) - np.repeat(ends - copies[chosen], copies[chosen])
                grid = (place[0][i], k) if is_home else (k, place[1][i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards[i]), *map(pa.array, grid), pa.array(ids[rows[i]]),
                     pa.array(fps[rows[i]].view(np.int64)), pa.array(np.full(len(i), is_home))],
                    ["shard", "home_block", "query_block", "node", "fp", "home"])

    def compare(table: pa.Table) -> pa.Table:
        home = table.column("home").to_numpy()
        ids, first, index = np.unique(table.column("node").to_numpy(), return_index=True,
                                      return_inverse=True)
        fps = table.column("fp").to_numpy().view(np.uint64)[first]
        forest = Forest(len(ids))
        search(fps, index[home], index[~home], bits, forest)
        pairs = np.array(forest.edges, np.int64).reshape(-1, 2)
        return pa.table({"a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]]})

    return points.mapInArrow(
        deal, "shard long, home_block long, query_block long, node long, fp long, home boolean"
    ).groupBy("shard", "home_block", "query_block").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, bits: int = BITS,
                    shard: int = SHARD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = cut(fingerprints(docs, width))
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    named = cut(points.where("node IS NOT NULL"))
    unnamed = points.where("node IS NULL")
    groups = components(links(named, bits, shard))
    labelled = named.join(groups, "node", "left").select(
        "fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(labelled.unionByName(
        unnamed.select("fp", F.col("node").alias("component_id"))), "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, width: int = SHINGLE, bits: int = BITS,
               shard: int = SHARD) -> DataFrame:
    """One document of each group: the one whose id is the group's, once if its row is repeated. Rows
    without an id can't be named and stay."""
    kept = near_duplicates(docs, width, bits, shard).where("doc_id = component_id").select(
        F.col("doc_id").alias("kept")).distinct()
    # whole rows travel as one value, so columns of any name may come along
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"),
                       F.col("text").alias("text"))
    return rows.join(kept, F.col("id") == F.col("kept"), "left_semi").dropDuplicates(
        ["id", "text"]).unionByName(rows.where("id IS NULL")).select("row.*")
