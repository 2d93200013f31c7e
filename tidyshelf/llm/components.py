"""Connected components of a graph given by its edges, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyshelf.session import cut


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Links neighbours to the least node of each neighbourhood: those above the node (large star), or
    those not above it and the node itself (small star). Only minima per node are gathered."""
    if small:
        seen = edges
    else:
        seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = seen.join(least, "a")
    if small:  # a > b in every edge
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    else:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (columns a, b, any order); the component is its
    least node. The rounds end when no edge moves; each is written to the shared folder."""
    held = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
               .where("a > b").distinct())
    mark = _mark(held)
    while True:
        held = cut(_star(_star(held, small=False), small=True))
        now = _mark(held)
        if now == mark:
            break
        mark = now
    return held.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        held.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free digest of the edges."""
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"),
                    F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)
