"""Substring search by an index of trigrams, with the same hits as ``grid.search``.

An index is a folder of three tables, each with a folder per batch of rows, which a replay replaces:

* ``rows``: the rows, by ranges of ``row_idx``;
* ``grams`` (gram, row_idx): the different runs of three characters of a row's searched cells in lower case, by
  ranges of gram and row, so that a frequent gram is many files and a lookup reads the files of its grams only;
* ``counts`` (gram, rows).

A term's pieces between wildcards give its grams. The rarest few of them name the candidates, which are then held
against the term itself. Where the rarest gram has few rows, these are looked up by number, which the ranges
of ``rows`` prune; else they are joined. A term without a piece of three characters reads all rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyshelf.operators import grid

FEW = 2000           # rows that are looked up by number rather than joined
RAREST = 4           # grams of a term that are intersected


def grams(value: Column) -> Column:
    """The different runs of three characters of the lower-case value, which is split once."""
    once = lambda c, body: F.get(F.transform(F.array(c), body), F.lit(0))
    three = lambda chars: F.transform(F.sequence(F.lit(0), F.size(chars) - 3), lambda i: F.concat(
        *[F.get(chars, i + k) for k in range(3)]))
    return once(F.split(F.lower(value), ""), lambda chars: F.when(
        F.size(chars) >= 3, F.array_distinct(three(chars))).otherwise(F.array().cast("array<string>")))


def build(rows: DataFrame, index: str, columns: list[str] = grid.SEARCHED, row_idx: str = "row_idx",
          batch_id: int = 0, ranges: int | None = None) -> None:
    """Writes the index of a batch of rows."""
    spark = rows.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = f"{index}/rows/batch_id={batch_id}"
    rows.repartitionByRange(ranges, row_idx).sortWithinPartitions(row_idx).write.mode("overwrite").parquet(stored)
    own = spark.read.schema(rows.schema).parquet(stored)
    every = F.array_distinct(F.concat(*[grams(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]))
    own.select(F.explode(every).alias("gram"), F.col(row_idx).alias("row_idx")).repartitionByRange(
        ranges, "gram", "row_idx").sortWithinPartitions("gram", "row_idx").write.mode("overwrite").parquet(
        f"{index}/grams/batch_id={batch_id}")
    spark.read.parquet(f"{index}/grams/batch_id={batch_id}").groupBy("gram").agg(
        F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{index}/counts/batch_id={batch_id}")


def term_grams(spark: SparkSession, term: str) -> list[str]:
    """The grams every hit must hold."""
    pieces = [p for p in re.split("[%_]", term) if p]
    if not pieces:
        return []
    low = spark.range(1).select(*[F.lower(F.lit(p)) for p in pieces]).first()
    return sorted({p[i:i + 3] for p in low for i in range(len(p) - 2)})


def search(spark: SparkSession, index: str, term: str | None, columns: list[str] = grid.SEARCHED,
           row_idx: str = "row_idx") -> DataFrame:
    """Rows with the term in any of the columns, whatever the case; ``%`` and ``_`` are wildcards."""
    rows = spark.read.parquet(f"{index}/rows").drop("batch_id")
    wanted = term_grams(spark, term) if term else []
    if not wanted:
        return grid.search(rows, term, columns)
    found = {r["gram"]: r["n"] for r in spark.read.parquet(f"{index}/counts").where(
        F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum("rows").alias("n")).collect()}
    if len(found) < len(wanted):
        return rows.limit(0)
    rarest = sorted(found, key=lambda g: (found[g], g))[:RAREST]
    postings = spark.read.parquet(f"{index}/grams").where(F.col("gram").isin(rarest))
    hits = postings.groupBy("row_idx").agg(F.count_distinct("gram").alias("n")).where(
        F.col("n") == len(rarest)).select(F.col("row_idx").alias("_hit"))
    if found[rarest[0]] <= FEW:
        few = [r["_hit"] for r in hits.collect()]
        return grid.search(rows.where(F.col(row_idx).isin(few)), term, columns)
    return grid.search(rows.join(hits, F.col(row_idx) == F.col("_hit"), "left_semi"), term, columns)
