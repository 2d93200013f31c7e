"""Pages by rank: any page of a sorted table is read from the one or two ranges that hold it.

``store`` writes a copy of the table per order, cut into ranges of the order, and how many rows each range has. An
offset then names its range by a running sum over the counts; only that range's files are read and sorted, so page
100,000 costs what page 1 costs, and no task holds offset + limit rows. The order is that of ``grid.page``: NULL
first when rising and last when falling, equal values by the tie column.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Rows a range should hold; a page reads one or two ranges.
RANGE_ROWS = 1 << 16


def _order(sort_by: str, descending: bool, tie: str) -> list[Column]:
    first = F.col(sort_by).desc() if descending else F.col(sort_by).asc()
    return [first] + ([F.col(tie).asc()] if tie != sort_by else [])


def store(df: DataFrame, target: str, sort_by: str, descending: bool = False, tie: str = "row_idx",
          range_rows: int = RANGE_ROWS) -> None:
    """Writes the copy for one order. ``tie`` must differ between rows for pages to be of one mind."""
    order = _order(sort_by, descending, tie)
    ranges = max(1, -(-df.count() // range_rows))
    (df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
     .sortWithinPartitions("_range", *order).write.mode("overwrite").partitionBy("_range").parquet(f"{target}/rows"))
    spark = df.sparkSession
    df.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{target}/empty")
    stored = spark.read.schema(StructType([*df.schema.fields, StructField("_range", IntegerType())])).parquet(f"{target}/rows")
    stored.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode(
        "overwrite").parquet(f"{target}/counts")


def starts(spark: SparkSession, target: str) -> tuple[list[int], list[int]]:
    """(ranges, rows before each and in all): two numbers per range, not per row."""
    counts = sorted((r["_range"], r["n"]) for r in spark.read.parquet(f"{target}/counts").collect())
    return [r for r, _ in counts], [0, *accumulate(n for _, n in counts)]


def page(spark: SparkSession, target: str, number: int = 1, size: int = 25, sort_by: str = "row_idx",
         descending: bool = False, tie: str = "row_idx") -> DataFrame:
    """One page of the stored order, with ``rank`` from 1. Pages before the first and after the last are empty."""
    names, before = starts(spark, target)
    first, empty = (number - 1) * size, spark.read.parquet(f"{target}/empty")
    if not names or first < 0 or first >= before[-1]:
        return empty.withColumn("rank", F.lit(None).cast("long"))
    last = min(first + size, before[-1])
    low, high = bisect_right(before, first) - 1, bisect_right(before, last - 1) - 1
    held = spark.read.schema(empty.schema).parquet(*[f"{target}/rows/_range={n}" for n in names[low:high + 1]])
    order = _order(sort_by, descending, tie)
    part = held.orderBy(*order).offset(first - before[low]).limit(last - first)
    # a page is ranked by itself: one window over its few rows
    rank = F.row_number().over(W.orderBy(*order)) + F.lit(first)
    return part.withColumn("rank", rank.cast("long"))


def page_info(spark: SparkSession, target: str, size: int = 25) -> tuple[int, int]:
    """(rows, pages) from the counts alone."""
    total = starts(spark, target)[1][-1]
    return total, -(-total // size)
