"""The whole job: raw catalogue to the eight result tables."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyshelf.operators import conflicts as conflict_ops
from tidyshelf.operators import duplicates, enrich, mapping, score, validate
from tidyshelf.operators.normalize import normalize, product_attributes
from tidyshelf.session import beside, cut, spread
from tidyshelf.sources import catalog, sinks


@dataclass
class Result:
    """The frames of one run; those that several results need are stored."""

    products: DataFrame
    issues: DataFrame
    clusters: DataFrame
    groups: DataFrame
    items: DataFrame
    conflicts: DataFrame
    enrichment: DataFrame
    attributes: DataFrame


def run(raw: DataFrame, schema_mapping: dict[str, str] | None = None,
        raw_columns: list[str] | None = None, threshold: float = duplicates.THRESHOLD,
        enrich_limit: int | None = None, pairs: str = "first") -> Result:
    """Normalise, cluster, enrich, validate, find conflicts, score.

    ``raw`` has ``row_idx``. Several stages read the normalised frame, so it is
    written once to the checkpoint folder rather than recomputed or held in the
    memory of executors that may be lost.
    """
    columns = raw_columns or [c for c in raw.columns if c != "row_idx"]
    clean = cut(normalize(raw, schema_mapping))
    clusters = cut(duplicates.cluster(clean, threshold))
    enrichment = enrich.enrich(clean, enrich_limit)
    checked = cut(validate.validate(clean))
    found = cut(conflict_ops.detect_conflicts(clean, columns, clusters, pairs))
    scored = score.score(checked, conflict_ops.conflict_row_ids(found))
    products = enrich.mark_enriched(scored, enrichment)
    items = cut(duplicates.duplicate_items(clean, clusters))
    return Result(
        products=products, issues=validate.issue_rows(checked), clusters=clusters,
        groups=duplicates.duplicate_groups(items), items=items, conflicts=found,
        enrichment=enrichment, attributes=product_attributes(clean))


def save(result: Result, root: str, job_id: str) -> None:
    """Writes the result tables of one job."""
    for name, df in [
        ("products", result.products.drop("issues")), ("validation_issues", result.issues),
        ("duplicate_groups", result.groups), ("duplicate_items", result.items),
        ("conflicts", result.conflicts), ("enrichment", result.enrichment),
        ("product_attributes", result.attributes),
    ]:
        sinks.write_table(df, root, name, job_id)


def process_file(spark: SparkSession, path: str, root: str, job_id: str,
                 schema_mapping: dict[str, str] | None = None, **options) -> DataFrame:
    """Reads one catalogue, runs the job, stores all tables; returns the job record.

    Without a mapping the columns are analysed first.
    """
    started = time.time()
    raw = spread(cut(catalog.read_catalog(spark, path)), "row_idx")
    mapping_used = schema_mapping or mapping.mapping_of(mapping.analyze(raw, whole=True))
    save(run(raw, mapping_used, **options), root, job_id)
    stats = job_stats(spark, root, job_id).first().asDict()
    seconds = round(time.time() - started, 2)
    stats |= {"duration_seconds": seconds,
              "throughput_rows_per_sec": round(stats["total_products"] / max(0.1, seconds), 1)}
    record = sinks.job_record(spark, job_id, path.rstrip("/").rsplit("/", 1)[-1], _size(spark, path),
                              "completed", stats, stats["total_products"])
    sinks.write_table(record, root, "jobs")
    return catalog.job_scan(sinks.read_table(spark, root, "jobs"), job_id)


def job_stats(spark: SparkSession, root: str, job_id: str) -> DataFrame:
    """Counts and mean quality of a stored job: one row."""
    table = lambda name: catalog.job_scan(sinks.read_table(spark, root, name), job_id)
    count = lambda name, alias: table(name).agg(F.count(F.lit(1)).alias(alias))
    return beside(
        table("products").agg(
            F.count(F.lit(1)).alias("total_products"),
            F.count_if("ai_enriched").alias("ai_enriched_count"), *score.mean_scores()),
        count("duplicate_groups", "duplicate_groups_count"), count("conflicts", "conflicts_count"),
        table("validation_issues").agg(
            F.count(F.lit(1)).alias("validation_issues_count"),
            F.count_if(F.col("issue_type") == "missing_value").alias("missing_attributes_count")))


def _size(spark: SparkSession, path: str) -> int:
    """Bytes of the scanned files, from the listing alone."""
    files = spark.read.format("binaryFile").load(path).select("length")
    return files.agg(F.sum("length").alias("s")).first()["s"] or 0
