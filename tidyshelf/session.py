"""Session helpers: checkpoint folder and dense numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def local_session(name: str = "tidyshelf", cores: str = "8", **conf) -> SparkSession:
    """Session for tests and the bench; a cluster job brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", conf.pop("partitions", cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        # Methods beyond 8000 bytes of byte code are not compiled by the JVM; wide
        # projections run faster as split code than as one huge method.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a temporary folder, because a machine-local one
    would be lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tidyshelf-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes the frame to the shared checkpoint folder and reads it back.

    Ends the lineage, survives the loss of executors, and later steps read only
    the columns they need, with known sizes, from Parquet.
    """
    path = f"{use_checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str, rows: int = 50_000, least: int = 1000) -> DataFrame:
    """The rows dealt out by a unique column, at most some ``rows`` a task.

    A narrow table takes few bytes a row, so millions of rows are one or two scan tasks, and so is all that is
    made of them row by row. Where that work is dear, its tasks must be counted by rows. Of a Parquet
    table the count reads the footers only. Small tables keep ``least`` rows a task.
    """
    n = df.count()
    tasks = max(-(-n // rows), min(df.sparkSession.sparkContext.defaultParallelism, -(-n // least)))
    return df.repartition(tasks, key) if tasks > 1 else df


def number_rows(df: DataFrame, order: str, out: str, start: int = 0,
                width: int = 1 << 20) -> DataFrame:
    """Dense numbers 0, 1, 2, ... in the order of a unique, non-negative integer column.

    A global window would sort the whole table in one task. Here each slice of
    ``width`` consecutive ids is numbered on its own and shifted by the row
    count of the slices before it; only those counts meet in one task.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(order) / width))
    counts = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = W.partitionBy("_slice").orderBy(order)
    return (
        sliced.join(starts, "_slice")
        .withColumn(out, (F.row_number().over(within) - 1 + F.col("_start") + start).cast("bigint"))
        .drop("_slice", "_start")
    )


def beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row frames of different columns as one row, without a join."""
    stacked = first
    for other in others:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
