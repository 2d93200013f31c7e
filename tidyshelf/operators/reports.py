"""Dashboard, analytics, quality and source reports.

Every report is one aggregate over the table it is about; averages of nothing
are NULL, not a made-up figure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyshelf.functions import text
from tidyshelf.operators import score
from tidyshelf.session import beside

CONFIDENCE_BANDS = [("conf_90_100", 0.9), ("conf_80_89", 0.8), ("conf_70_79", 0.7),
                    ("conf_below_70", None)]


def _filled(*columns: str):
    def test() -> Column:
        out = F.coalesce(F.col(columns[0]), F.lit("")) != ""
        for c in columns[1:]:
            out = out & (F.coalesce(F.col(c), F.lit("")) != "")
        return out
    return test


# Line of the coverage report -> when a product counts for it.
COVERED = [
    ("Technical Document / PDF", _filled("technical_document")),
    ("Direct Product URL", _filled("product_url")),
    ("Supplier ID / Master", _filled("supplier")),
    ("Manufacturer / Brand Lineage", _filled("brand")),
    ("Power / Voltage Specs", _filled("power", "voltage")),
]


def averages(scored: DataFrame) -> DataFrame:
    return scored.agg(*score.mean_scores())


def ai_confidence(products: DataFrame) -> DataFrame:
    """Mean confidence over enriched rows only."""
    return products.agg(text.percent(F.avg(F.when(F.col("ai_enriched"), F.col("ai_confidence"))))
                        .alias("ai_confidence"))


def top_groups(df: DataFrame, column: str, k: int, blank: str, *more: Column) -> DataFrame:
    """Top k values by count, ties by name; ``more`` are further aggregates."""
    name = text.first_filled(F.col(column), F.lit(blank))
    return df.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("count"), *more).orderBy(
        F.desc("count"), "name").limit(k)


def category_distribution(products: DataFrame, k: int = 10) -> DataFrame:
    return top_groups(products, "category", k, "Uncategorized")


def _mean_quality() -> Column:
    return F.round(F.avg("quality_score"), 1).alias("avg_quality")


def brand_breakdown(scored: DataFrame, k: int = 10) -> DataFrame:
    return top_groups(scored, "brand", k, "Unknown", _mean_quality())


def supplier_breakdown(scored: DataFrame, k: int = 8) -> DataFrame:
    return top_groups(scored, "supplier", k, "Direct", _mean_quality())


def quality_histogram(scored: DataFrame) -> DataFrame:
    return scored.agg(*score.band_counts("quality_score"))


def confidence_histogram(products: DataFrame) -> DataFrame:
    return products.agg(*score.band_counts("ai_confidence", CONFIDENCE_BANDS))


def issues_by_field(issues: DataFrame) -> DataFrame:
    return issues.groupBy(F.col("field").alias("raw_field")).agg(
        F.count(F.lit(1)).alias("count")).withColumn(
        "field", text.field_label(F.col("raw_field"))).orderBy(F.desc("count"), "raw_field")


def issues_by_type(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_type").agg(F.count(F.lit(1)).alias("count")).select(
        text.title_label(F.col("issue_type")).alias("type"), "count").orderBy(
        F.desc("count"), "type")


def issues_by_severity(issues: DataFrame) -> DataFrame:
    return issues.agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")],
        F.count_if(F.col("severity").isin("high", "medium", "low")).alias("total"))


def missing_attributes(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count_if(F.col("issue_type") == "missing_value").alias(
        "missing_attributes"))


def kpis(scored: DataFrame, issues: DataFrame, conflicts: DataFrame,
         groups: DataFrame) -> DataFrame:
    """Headline counts of the catalogue, one aggregate per table."""
    return beside(
        scored.agg(F.count(F.lit(1)).alias("products_processed"), *score.mean_scores()),
        issues.agg(F.count(F.lit(1)).alias("total_validation_issues"),
                   F.count_if(F.col("issue_type") == "missing_value").alias("missing_attributes")),
        conflicts.agg(F.count(F.lit(1)).alias("conflicts_detected")),
        groups.agg(F.count(F.lit(1)).alias("duplicate_groups")))


def funnel(scored: DataFrame, clusters: DataFrame) -> DataFrame:
    """Stages with counts and shares. "Deduplicated" drops the redundant rows."""
    dup = clusters.agg(
        F.coalesce(F.sum(F.when(F.col("row_idx") != F.col("centre"), 1).otherwise(0)), F.lit(0))
        .alias("redundant"),
        F.count_if(F.col("row_idx") == F.col("centre")).alias("groups"))
    return funnel_rows(beside(scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("ai_enriched")).alias("enriched"),
        F.count_if(F.col("validation_status") == "valid").alias("valid"),
        F.count_if(F.col("quality_score") >= 70).alias("ready")), dup))


def funnel_rows(counted: DataFrame) -> DataFrame:
    """The stages of one row of counters."""
    stages = [("Uploaded", "total"), ("Parsed & Schema", "total"), ("Normalized", "total"),
              ("Deduplicated", "total - redundant"), ("Deduplicated (by groups)", "total - groups"),
              ("AI Enriched", "enriched"), ("Validated", "valid"), ("Commerce Ready", "ready")]
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("stage"),
                 F.expr(e).cast("bigint").alias("count")) for i, (name, e) in enumerate(stages)])
    return counted.select("total", F.inline(rows)).select(
        "position", "stage", "count",
        text.percent(F.col("count") / F.greatest("total", F.lit(1))).alias("percentage"))


def category_scores(scored: DataFrame) -> DataFrame:
    """Quality, completeness and validity per category, best first."""
    return scored.groupBy(text.first_filled(F.col("category"), F.lit("General"))
                          .alias("category")).agg(
        F.round(F.avg("quality_score"), 1).alias("quality"),
        text.percent(F.avg("completeness_score")).alias("completeness"),
        text.percent(F.avg("validity_score")).alias("validity"),
    ).orderBy(F.desc("quality"), "category")


def source_scores(scored: DataFrame) -> DataFrame:
    """Count, share, averages and reliability tier per source."""
    per_source = scored.groupBy(text.first_filled(F.col("source"), F.lit("Catalog Source"))
                                .alias("name")).agg(
        F.count(F.lit(1)).alias("product_count"), F.avg("quality_score").alias("q"),
        F.avg("completeness_score").alias("c"), F.avg("validity_score").alias("v"))
    # A scalar subquery, so the share needs no window over all sources.
    return source_rows(per_source, scored.agg(F.count(F.lit(1)).alias("total")).scalar())


def source_rows(per_source: DataFrame, total: Column) -> DataFrame:
    """The report of sources with their count and means ``q``, ``c``, ``v``."""
    return per_source.select(
        "name", "product_count", text.percent(F.col("product_count") / total)
        .alias("share_percentage"),
        F.round("q", 1).alias("quality_score"), text.percent(F.col("c")).alias("completeness_score"),
        text.percent(F.col("v")).alias("validity_score"),
        F.when(F.col("q") >= 80, F.lit("High")).otherwise(F.lit("Medium")).alias("reliability_tier"),
    ).orderBy(F.desc("product_count"), "name")


def field_coverage(products: DataFrame) -> DataFrame:
    """Populated count and share for documents, links, suppliers, brands and specs."""
    return coverage_rows(products.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(test()).alias(f"n{i}") for i, (_, test) in enumerate(COVERED)]))


def coverage_rows(counted: DataFrame) -> DataFrame:
    """The report of one row of counters: ``total`` and ``n<line>``."""
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(name).alias("field"),
                              F.col(f"n{i}").alias("populated"))
                     for i, (name, _) in enumerate(COVERED)])
    return counted.select("total", F.inline(rows)).select(
        "position", "field", "populated",
        text.percent(F.col("populated") / F.greatest("total", F.lit(1))).alias("coverage_pct"))


def throughput(jobs: DataFrame) -> DataFrame:
    """Rows per second of each job."""
    return jobs.select(
        "job_id", "total_rows", "duration_seconds",
        F.round(F.col("total_rows") / F.greatest("duration_seconds", F.lit(0.1)), 1)
        .alias("products_per_second"))


def job_status(jobs: DataFrame, job_id: str | None = None) -> DataFrame:
    """State, progress and counters of one job, or of all."""
    stat = lambda k: F.coalesce(F.try_element_at("stats", F.lit(k)).try_cast("double"), F.lit(0.0))
    state = F.when(F.col("status").isin("completed", "failed"), F.col("status")).otherwise(
        F.lit("processing"))
    done = F.col("status") == "completed"
    picked = jobs if job_id is None else jobs.where(F.col("job_id") == job_id)
    return picked.select(
        "job_id", "filename", "file_size", "total_rows", state.alias("status"),
        F.when(done, 100.0).otherwise(stat("progress")).alias("progress_percentage"),
        stat("throughput_rows_per_sec").alias("speed"),
        *[stat(k).cast("bigint").alias(a) for a, k in [
            ("ai_enriched", "ai_enriched_count"), ("duplicates", "duplicate_groups_count"),
            ("conflicts", "conflicts_count"), ("missing_attributes", "missing_attributes_count")]],
        F.coalesce(F.try_element_at("stats", F.lit("message")),
                   F.when(done, F.lit("Processing complete"))
                   .otherwise(F.lit("Processing catalog..."))).alias("message"), "created_at")


def biggest_problems(issues: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent combinations of severity, type and field."""
    return issues.groupBy("severity", "issue_type", "field").agg(
        F.count(F.lit(1)).alias("count")).orderBy(
        F.desc("count"), "severity", "issue_type", "field").limit(k)


def needs_review(scored: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Products that are not valid or have a pending conflict."""
    pending = conflicts.where("status = 'pending'").groupBy("row_idx").agg(
        F.count(F.lit(1)).alias("pending_conflicts"))
    return scored.join(pending, "row_idx", "left").where(
        "validation_status <> 'valid' or pending_conflicts > 0").select(
        "row_idx", "product_id", "validation_status", "quality_score",
        F.coalesce("pending_conflicts", F.lit(0)).alias("pending_conflicts"))


def least_complete_categories(scored: DataFrame, issues: DataFrame) -> DataFrame:
    """Categories by rising completeness, with the field most often missing in each."""
    means = scored.groupBy("category").agg(
        text.percent(F.avg("completeness_score")).alias("completeness"),
        F.count(F.lit(1)).alias("product_count"))
    missing = issues.where("issue_type = 'missing_value'").join(
        scored.select("row_idx", "category"), "row_idx").groupBy("category", "field").agg(
        F.count(F.lit(1)).alias("n"))
    # Largest count first, then the first name: the smallest of (-count, name).
    worst = missing.groupBy("category").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("field").alias("field"))).alias("w"))
    return means.join(worst, "category", "left").select(
        "category", "completeness", "product_count",
        F.coalesce("w.field", F.lit("")).alias("most_missing_field")).orderBy(
        "completeness", "category")


def supplier_conflicts(products: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Conflicts per supplier and their share of all, most first."""
    per = conflicts.select("row_idx").join(products.select("row_idx", "supplier"), "row_idx"
                                           ).groupBy("supplier").agg(
        F.count(F.lit(1)).alias("conflict_count"))
    total = conflicts.agg(F.count(F.lit(1)).alias("total")).scalar()
    return per.select(
        "supplier", "conflict_count",
        text.percent(F.col("conflict_count") / total).alias("share_pct"),
    ).orderBy(F.desc("conflict_count"), "supplier")


