"""Incremental catalogue feed: files are cleaned, validated and scored as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from tidyshelf.operators import score, validate
from tidyshelf.operators.normalize import normalize
from tidyshelf.sources.catalog import number_splits
from tidyshelf.streaming import clusters

#: Row numbers set aside for each batch.
BATCH_ROWS = 1 << 40


def read_feed(spark: SparkSession, folder: str, columns: list[str], fmt: str = "csv",
              **options) -> DataFrame:
    """Stream of new files with a fixed all-text schema, and the file and split each row is from."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    reader = spark.readStream.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    for k, v in options.items():
        reader = reader.option(k, v)
    raw = reader.format(fmt).load(folder)
    return raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns],
                      F.col("_metadata.file_path").alias("feed_file"),
                      F.col("_metadata.file_block_start").alias("feed_at"))


def clean_feed(raw: DataFrame, batch_id: int, mapping: dict[str, str] | None = None) -> DataFrame:
    """One batch of the feed through the same operators as a whole catalogue.

    ``row_idx`` is the place of a row among its batch's files after ``batch_id * BATCH_ROWS``: equal lines
    stay apart, and a replay, which reads the same files, gives the same numbers. Scores here have no
    conflict part; duplicates across batches are found by ``start_feed(state=...)``.
    """
    placed = raw.withColumnsRenamed({"feed_at": "_at"}).withColumn("_path", F.col("feed_file")).withColumn(
        "_id", F.monotonically_increasing_id())
    numbered = number_splits(placed, "row_idx").withColumn(
        "row_idx", F.col("row_idx") + F.lit(batch_id * BATCH_ROWS))
    return score.score(validate.validate(normalize(numbered, mapping, keep=["feed_file"])))


def start_feed(raw: DataFrame, target: str, checkpoint: str, mapping: dict[str, str] | None = None,
               available_now: bool = True, state: str | None = None) -> StreamingQuery:
    """Cleans and writes each micro-batch into its own partition, so a replay replaces it.

    With a folder for ``state`` each batch's rows are clustered with those of all batches before it:
    ``clusters.clusters`` and ``clusters.touched`` read the result.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        (clean_feed(batch, batch_id, mapping).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite")
         .partitionBy("batch_id").option("partitionOverwriteMode", "dynamic").parquet(target))
        if state:
            landed = batch.sparkSession.read.parquet(target).where(F.col("batch_id") == batch_id)
            clusters.add_batch(landed, state, batch_id)

    writer = raw.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now
            else writer.trigger(processingTime="30 seconds")).start()
