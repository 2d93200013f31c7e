"""Exports (fixed column layouts) and result tables partitioned by job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidyshelf import fixed_values as fv
from tidyshelf.functions import text
from tidyshelf.operators import enrich

TABLES = ["jobs", "products", "product_attributes", "validation_issues", "duplicate_groups",
          "duplicate_items", "conflicts", "enrichment"]


def catalog_export(products: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Clean catalogue with the 24 export columns in fixed order, every row once."""
    best = enrich.best_values(products, enrichment)
    special = {
        "price": F.col("price"),
        "currency": text.first_filled(F.col("currency"), F.lit("USD")),
        "quality_score": F.coalesce(F.round("quality_score", 1), F.lit(0.0)),
        "ai_confidence": F.when(F.col("ai_confidence") <= 1, text.percent(F.col("ai_confidence")))
        .otherwise(F.round("ai_confidence", 1)),
        "validation_status": text.first_filled(F.col("validation_status"), F.lit("valid")),
    }
    return best.select(*[
        special.get(f, F.coalesce(F.col(f), F.lit(""))).alias(name)
        for name, f in fv.EXPORT_COLUMNS])


def conflict_export(conflicts: DataFrame) -> DataFrame:
    c = F.col
    return conflicts.select(
        F.concat_ws("/", c("row_idx").cast("string"), "field").alias("Conflict ID"),
        c("product_name").alias("Product Name"), c("model_number").alias("Model Number"),
        c("field").alias("Field"), c("source_a").alias("Source A"), c("value_a").alias("Value A"),
        c("source_b").alias("Source B"), c("value_b").alias("Value B"),
        c("severity").alias("Severity"), c("explanation").alias("AI Explanation"),
        c("status").alias("Status"), c("resolution_notes").alias("Resolution Notes"))


def duplicate_export(groups: DataFrame, items: DataFrame) -> DataFrame:
    c = F.col
    head = groups.select(c("canonical_row_idx").alias("centre"), "group_code", "status",
                         c("similarity").alias("group_similarity"), "canonical_name")
    return items.join(head, "centre").select(
        c("group_code").alias("Group Code"), c("status").alias("Group Status"),
        text.percent(c("group_similarity")).alias("Cluster Similarity %"),
        c("canonical_name").alias("Canonical Product"), c("product_id").alias("Product ID"),
        c("product_name").alias("Product Name"), c("brand").alias("Brand"),
        c("model_number").alias("Model Number"), c("specs_summary").alias("Specs Summary"))


def validation_export(issues: DataFrame) -> DataFrame:
    c = F.col
    return issues.select(
        F.concat_ws("/", c("row_idx").cast("string"), "field", "issue_type").alias("Issue ID"),
        c("product_id").alias("Product ID"), c("field").alias("Field"),
        c("issue_type").alias("Issue Type"), c("severity").alias("Severity"),
        c("message").alias("Message"), c("raw_value").alias("Raw Value"))


def write_csv(df: DataFrame, path: str, single_file: bool = False,
              order_by: str | None = None) -> None:
    """CSV with a header. ``single_file`` is for small reports; big ones stay in parts."""
    out = df if order_by is None else df.orderBy(order_by)
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_table(df: DataFrame, root: str, name: str, job_id: str | None = None) -> None:
    """One job's rows of a result table.

    Only the job's own partition is replaced, so a rerun leaves no copies behind
    and other jobs stay as they are.
    """
    out = df if job_id is None else df.withColumn("job_id", F.lit(job_id))
    (out.write.mode("overwrite").partitionBy("job_id")
        .option("partitionOverwriteMode", "dynamic").parquet(f"{root}/{name}"))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A result table of all jobs. Job ids stay text, whatever they look like."""
    path = f"{root}/{name}"
    stored = spark.read.parquet(path).schema
    schema = StructType([
        StructField(f.name, StringType()) if f.name == "job_id" else f for f in stored.fields])
    return spark.read.schema(schema).parquet(path)


def job_record(spark: SparkSession, job_id: str, filename: str, file_size: int, status: str,
               stats: dict[str, object], total_rows: int) -> DataFrame:
    """The job's summary row."""
    return spark.range(1).select(
        F.lit(job_id).alias("job_id"), F.lit(filename).alias("filename"),
        F.lit(file_size).cast("bigint").alias("file_size"),
        F.lit(total_rows).cast("bigint").alias("total_rows"), F.lit(status).alias("status"),
        F.create_map(*[F.lit(str(x)) for kv in stats.items() for x in kv]).alias("stats"),
        F.current_timestamp().alias("created_at"))
