"""Decisions and renewed enrichments on a stored job: written back, validated and scored again.

A change replaces the partitions of its job in the tables it touches and leaves other jobs alone. Each new
partition is written to the checkpoint folder before it replaces the old one, so no table is read while it
is overwritten, and a change that is sent again gives the same tables: decisions carry their time, the last
one counts, and an accepted value does not alter the conflict it comes from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyshelf.operators import conflicts as conflict_ops
from tidyshelf.operators import duplicates, enrich, score, validate
from tidyshelf.plans import pipeline
from tidyshelf.session import cut
from tidyshelf.sources import catalog, sinks

SETTLED = ("accept_a", "accept_b")


def table(spark: SparkSession, root: str, name: str, job_id: str) -> DataFrame:
    """The job's rows of a result table, without the job's column."""
    return catalog.job_scan(sinks.read_table(spark, root, name), job_id).drop("job_id")


def rescore(products: DataFrame, conflicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products and their issues anew. Conflicts that a decision settled no longer count against a row."""
    bare = products.drop("issues", "validation_status", *score.SCORES)
    checked = validate.validate(bare)
    still = conflicts.where(~F.col("status").isin(*SETTLED))
    scored = score.score(checked, conflict_ops.conflict_row_ids(still))
    return scored.select(*products.drop("issues").columns), validate.issue_rows(checked)


def decide_conflicts(spark: SparkSession, root: str, job_id: str, actions: DataFrame) -> None:
    """Stores decisions (row_idx, field, action, notes, acted_at), the values they accept, and new scores."""
    old = table(spark, root, "conflicts", job_id)
    decided = cut(conflict_ops.resolve_conflicts(old, actions).select(*old.columns))
    products = table(spark, root, "products", job_id)
    scored, issues = rescore(
        cut(conflict_ops.apply_resolutions(products, old, actions)), decided)
    _replace(root, job_id, conflicts=decided, products=cut(scored), validation_issues=cut(issues))
    refresh_record(spark, root, job_id)


def decide_groups(spark: SparkSession, root: str, job_id: str, actions: DataFrame) -> None:
    """Stores decisions on duplicate groups (group_code, action, notes, acted_at)."""
    old = table(spark, root, "duplicate_groups", job_id)
    _replace(root, job_id, duplicate_groups=cut(
        duplicates.resolve_groups(old, actions).select(*old.columns)))


def reenrich(spark: SparkSession, root: str, job_id: str, chosen: DataFrame,
             enricher: Callable[[DataFrame], DataFrame] = enrich.enrich) -> None:
    """Enriches the products of ``chosen`` (row_idx, repeats allowed) anew and marks them."""
    products = table(spark, root, "products", job_id)
    ids = chosen.select("row_idx").distinct()
    renewed = cut(enricher(products.join(ids, "row_idx", "left_semi")))
    old = table(spark, root, "enrichment", job_id)
    marks = renewed.select("row_idx", F.col("confidence_score").alias("_new"))
    marked = products.join(marks, "row_idx", "left").select(*[
        (F.col("_new").isNotNull() | F.col(c)).alias(c) if c == "ai_enriched"
        else F.coalesce("_new", c).alias(c) if c == "ai_confidence" else F.col(c)
        for c in products.columns])
    _replace(root, job_id, enrichment=cut(enrich.upsert(old, renewed.select(*old.columns))),
             products=cut(marked))
    refresh_record(spark, root, job_id)


def refresh_record(spark: SparkSession, root: str, job_id: str) -> None:
    """The job's record with counts and means of its tables as they are now; other entries stay."""
    record = table(spark, root, "jobs", job_id)
    now = pipeline.job_stats(spark, root, job_id).first().asDict()
    fresh = F.create_map(*[F.lit(None if x is None else str(x)).cast("string") for kv in now.items() for x in kv])
    kept = F.map_filter("stats", lambda k, _: ~k.isin(*now))
    _replace(root, job_id, jobs=cut(record.withColumn("stats", F.map_concat(kept, fresh))))


def _replace(root: str, job_id: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        sinks.write_table(df, root, name, job_id)
