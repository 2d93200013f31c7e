"""Catalogue scans: delimiter detection, records, clean headers, row numbers."""

from __future__ import annotations

import csv
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidyshelf.functions import text
from tidyshelf.sources.records import Quotes, records

_DELIMITERS = [",", "\t", ";", "|"]
_FORMAT_BY_EXTENSION = {
    ".csv": "csv", ".tsv": "csv", ".txt": "csv", ".json": "json", ".jsonl": "json",
    ".parquet": "parquet",
}


def _decoded(line: bytes) -> str:
    try:
        return line.decode("utf-8")
    except UnicodeDecodeError:
        return line.decode("latin-1")


def detect_layout(spark: SparkSession, path: str, sep: str | None = None) -> tuple[str, list[str]]:
    """Separator and headers of delimited files, judged on all lines of each.

    Preferred is the candidate that occurs in the header line and equally often in the
    most lines; failing that the most frequent one, and the comma when none occurs. Quoted parts
    are taken out before counting. Files that disagree are an error.
    """
    bare = F.regexp_replace("value", '"[^"]*"', "")
    counts = [f"n{i}" for i in range(len(_DELIMITERS))]
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("id")).alias("at"),
    ).where(F.trim("value") != "")
    # Lines with equal counts are one row before anything is shuffled.
    shapes = lines.select("file", "at", "value", *[
        (F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias(n)
        for n, d in zip(counts, _DELIMITERS)
    ]).groupBy("file", *counts).agg(
        F.count(F.lit(1)).alias("lines"), F.min(F.struct("at", "value")).alias("first"))
    headed = shapes.withColumn("head", F.min(F.struct("first", *counts)).over(W.partitionBy("file")))
    agreeing = lambda n: F.sum(F.when(
        (F.col(n) > 0) & (F.col(n) == F.col("head")[n]), F.col("lines")).otherwise(F.lit(0)))
    layouts = headed.groupBy("file").agg(
        F.first("head.first.value").cast("binary").alias("header"),
        *[F.struct(F.when(F.max(f"head.{n}") > 0, agreeing(n)).otherwise(F.lit(0)),
                   F.sum(F.col(n) * F.col("lines")), F.lit(-i)).alias(f"s{i}")
          for i, n in enumerate(counts)]
    ).select("header", (-F.greatest(*[f"s{i}" for i in range(len(counts))])["col3"]).alias("best"))
    # Different headers are refused below, so few rows tell.
    found = {
        (sep or _DELIMITERS[row["best"]], _decoded(row["header"]))
        for row in layouts.distinct().limit(1000).collect()
    }
    if any(Quotes(mark).inside(line.encode(), False) for mark, line in found):
        raise ValueError(f"a header in {path} has a line break")
    parsed = {
        (mark, tuple(h.strip() for h in next(csv.reader([line.lstrip("\ufeff")], delimiter=mark))))
        for mark, line in found
    }
    if len(parsed) > 1:
        raise ValueError(f"files of different layout in {path}")
    return (parsed.pop() if parsed else (sep or ",", ()))


def unique_headers(headers: list[str]) -> list[str | None]:
    """Trimmed headers by position; None for those without a name and for all but the last of equal
    ones. Of names that differ in case only, which Spark cannot tell apart, the earlier get a number.
    """
    names = [(h or "").strip().lstrip("\ufeff") for h in headers]
    out: list[str | None] = [
        name if name and name not in names[i + 1:] else None for i, name in enumerate(names)]
    taken = {name.lower() for name in out if name}
    seen = set()
    for i in range(len(out) - 1, -1, -1):
        name = out[i]
        if name and name.lower() in seen:
            number = 1
            while f"{name}_{number}".lower() in taken:
                number += 1
            out[i] = f"{name}_{number}"
            taken.add(out[i].lower())
        elif name:
            seen.add(name.lower())
    return out


def clean_cells(df: DataFrame, keep: list[str] | None = None,
                headers: list[str] | None = None) -> DataFrame:
    """All columns as trimmed text under trimmed headers, missing as ``""``.

    Columns named in ``keep`` pass through as they are. ``headers`` are the names by position, if
    not those of the frame. Columns shadowed by a later one of the same name, and those without a
    header, are dropped.
    """
    names = unique_headers(headers or df.columns)
    stage = df.toDF(*[f"c{i}" for i in range(len(names))])
    return stage.select(*[
        F.col(f"c{i}").alias(name) if name in (keep or [])
        else text.strip(F.coalesce(F.col(f"c{i}").cast("string"), F.lit(""))).alias(name)
        for i, name in enumerate(names) if name
    ])


def _with_scan_position(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_id"),
    )


def with_row_idx(df: DataFrame, out: str = "row_idx") -> DataFrame:
    """Dense row numbers in file order for a file scan.

    Each split of a file numbers its rows by itself and is shifted by the row
    count of the splits before it (by path and position in the file). Only one
    row per split takes part in the running sum, and no row goes through Python.
    """
    return number_splits(_with_scan_position(df), out)


def number_splits(placed: DataFrame, out: str) -> DataFrame:
    """Dense numbers by file (``_path``), split (``_at``) and place in the split (``_id``)."""
    splits = placed.groupBy("_path", "_at").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = W.orderBy("_path", "_at").rowsBetween(W.unboundedPreceding, -1)
    starts = splits.select(
        "_path", "_at", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        placed.join(starts, ["_path", "_at"])
        .withColumn(out, (F.col("_start") + F.col("_id") - F.col("_first")).cast("bigint"))
        .drop("_path", "_at", "_id", "_first", "_start")
    )


def read_catalog(spark: SparkSession, path: str, fmt: str | None = None, sep: str | None = None) -> DataFrame:
    """Messy catalogue as text columns plus ``row_idx``.

    ``fmt`` defaults to the extension (csv, tsv, txt, json, parquet; csv when
    unknown). Short CSV rows are padded and extra cells cut; all files of a folder must have
    the same header line. Quoted cells may hold line breaks, and each file has its own encoding:
    see ``records``. Large files are read in splits all the same.
    """
    fmt = fmt or _FORMAT_BY_EXTENSION.get(os.path.splitext(path.rstrip("/"))[1].lower(), "csv")
    if fmt == "csv":
        sep, headers = detect_layout(spark, path, sep)
        if not headers:
            return spark.createDataFrame([], "row_idx bigint")
        # Columns are read by position: Spark would rename repeated and blank headers.
        names = [f"c{i}" for i in range(len(headers))]
        cells = F.from_csv("text", ", ".join(f"{c} string" for c in names), {"sep": sep, "escape": '"', "mode": "PERMISSIVE"})
        rows = records(spark, path, sep).where("place > 0").select("row_idx", cells.alias("_cells"))
        return clean_cells(rows.select(*[F.col("_cells")[c].alias(c) for c in names], "row_idx"),
                           ["row_idx"], [*headers, "row_idx"])
    if fmt not in ("json", "parquet"):
        raise ValueError(f"unsupported format: {fmt}")
    raw = spark.read.format(fmt).load(path)
    return clean_cells(with_row_idx(raw, "_row_idx"), ["_row_idx"]).withColumnRenamed("_row_idx", "row_idx")


def job_scan(table: DataFrame, job_id: str) -> DataFrame:
    """Rows of one job; prunes partitions, as result tables are partitioned by job."""
    return table.where(F.col("job_id") == job_id)


def newest_job(jobs: DataFrame) -> DataFrame:
    """One row: the job created last."""
    return jobs.agg(F.max_by("job_id", "created_at").alias("job_id"))


def newest_job_rows(table: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows of the newest job. The one-row side prunes partitions at run time."""
    return table.join(F.broadcast(newest_job(jobs)), "job_id", "left_semi")
