"""Duplicates across the batches of a feed, against the stored centres of their blocks.

The rule is that of ``operators.duplicates``: rows are walked by ``row_idx``, and each joins the first centre
that shares a block with it and is similar enough, or becomes a centre. Rows of a batch come after all rows
before it, so they cannot change what is settled, and only centres need to be met again:

* a row equal to a stored centre in all keys joins it (a join on the keys);
* the others are compared with the stored centres of their blocks, and join the first that reaches them;
* what is left is clustered among itself, and its centres, lone rows among them, are stored.

The state is a folder of two tables, each batch in a folder of its own that a replay replaces:
``centres/batch_id=/slot=`` (block, node, keys, counts) and ``members/batch_id=`` (row_idx, centre). Slots are
hashes of blocks, so a batch reads the slots of its own blocks only. Batches are added in order of their
rows; a batch reads only those before it.

Both sides of a block are salted, so neither a hot block of the batch nor one with many centres is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyshelf.operators import duplicates
from tidyshelf.operators.duplicates import COUNTS, KEYS, SHARD, THRESHOLD
from tidyshelf.session import cut

#: Folders that the centres of a batch are spread over, at most.
SLOTS = 64

_MEMBER = "row_idx long, centre long, batch_id long"


def _slot(block: Column) -> Column:
    return F.pmod(F.xxhash64(block), F.lit(SLOTS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _stored(spark: SparkSession, state: str, table: str, schema: str) -> DataFrame:
    if not _exists(spark, f"{state}/{table}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{state}/{table}")


def _centre_schema(placed: DataFrame) -> str:
    kinds = dict(placed.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in ("block", "node", *KEYS, *COUNTS)) + ", batch_id long, slot int"


def _reached(placed: DataFrame, centres: DataFrame, floor: float) -> DataFrame:
    """(node, centre): the smallest stored centre that reaches each placed node of the batch."""
    spans = (placed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
             .join(centres.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("chunks")),
                   "block"))
    part = lambda n: F.pmod(F.col("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    old = centres.join(spans, "block").withColumn("chunk", part("chunks")).withColumn("shard", each("shards"))
    new = placed.join(spans, "block").withColumn("shard", part("shards")).withColumn("chunk", each("chunks"))
    on = ["block", "shard", "chunk"]
    pairs = duplicates._side(old, "a", *on).join(duplicates._side(new, "b", *on), on)
    return duplicates.reaching(pairs, floor).groupBy(F.col("b_node").alias("node")).agg(
        F.min("a_node").alias("centre"))


def add_batch(products: DataFrame, state: str, batch_id: int, floor: float = THRESHOLD) -> None:
    """Settles the rows of a batch and stores them. Every ``row_idx`` must exceed those of earlier batches."""
    spark = products.sparkSession
    keyed = cut(duplicates.with_keys(products).where("mk <> '' OR nm <> ''"))
    nodes = keyed.groupBy(*KEYS).agg(F.min("row_idx").alias("node"))
    placed = cut(duplicates.place(nodes).select("block", "node", *KEYS, *COUNTS))
    slots = [r[0] for r in placed.select(_slot(F.col("block"))).distinct().collect()]   # at most SLOTS
    centres = _stored(spark, state, "centres", _centre_schema(placed)).where(
        (F.col("batch_id") < batch_id) & F.col("slot").isin(slots)).drop("batch_id", "slot")

    heads = centres.select(*KEYS, F.col("node").alias("centre")).distinct()
    copies = cut(placed.select("node", *KEYS).distinct().join(heads, KEYS).select("node", "centre"))
    reached = _reached(placed.join(copies, "node", "left_anti"), centres, floor)
    settled = cut(copies.unionByName(reached))
    # from nodes to their rows, by the keys; what no stored centre reaches goes on
    of_keys = nodes.join(settled, "node", "left").drop("node")
    rows = cut(keyed.join(of_keys, KEYS))
    rest = rows.where("centre IS NULL").drop("centre")
    among = duplicates.cluster_keys(rest, floor).withColumnRenamed("centre", "found")
    own = cut(rest.join(among, "row_idx", "left").select(
        "row_idx", F.coalesce("found", "row_idx").alias("centre")))

    fresh = own.where("row_idx = centre").select(F.col("row_idx").alias("node"))
    placed.join(fresh, "node", "left_semi").select("block", "node", *KEYS, *COUNTS).withColumn(
        "slot", _slot(F.col("block"))).repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(
        f"{state}/centres/batch_id={batch_id}")
    rows.where("centre IS NOT NULL").select("row_idx", "centre").unionByName(own).write.mode(
        "overwrite").parquet(f"{state}/members/batch_id={batch_id}")


def _shared(members: DataFrame) -> DataFrame:
    sizes = members.groupBy("centre").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return members.join(sizes.select("centre"), "centre", "left_semi").select("row_idx", "centre")


def clusters(spark: SparkSession, state: str) -> DataFrame:
    """(row_idx, centre) of every row in a cluster of two or more, over all batches so far."""
    return _shared(_stored(spark, state, "members", _MEMBER))


def touched(spark: SparkSession, state: str, batch_id: int) -> DataFrame:
    """The clusters, with all their rows, that got a row in this batch: what to compare and report again."""
    members = _stored(spark, state, "members", _MEMBER).where(F.col("batch_id") <= batch_id)
    new = members.where(F.col("batch_id") == batch_id).select("centre").distinct()
    return _shared(members.join(new, "centre", "left_semi"))
