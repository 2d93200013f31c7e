"""Dashboard reports from stored states that add up.

One pass over a batch lays each product out as facts: one for the whole catalogue, one each for its
category, brand, supplier and source, one for each of its issues. Conflicts and cluster rows add theirs.
A single aggregate per (job, dimension, values) makes the batch's state; counts and sums in whole units
of the scores' decimals, so states add up exactly, in any order. A batch reads its own rows only, and a
report reads the few state rows of its dimension instead of the products.

A state is as large as the values of a dimension are many, not as the rows are. NULL and '' are one
value. Sums in the issue dimension go over the products that have the issue, once per issue. Of an empty
table there is no state; reports then give counts of 0 and averages of NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyshelf.functions import text
from tidyshelf.operators import gaps, reports, score
from tidyshelf.session import beside

KEYS = ["job_id", "dim", "a", "b", "c", "d"]
# Score -> units of one: the decimals that score.score keeps.
SUMS = {"quality_score": 10, "completeness_score": 1000, "validity_score": 1000,
        "consistency_score": 1000, "source_agreement_score": 1000}
CONFIDENCE = 1_000_000
COUNTS = ([name for name, _ in score.BANDS] + [name for name, _ in reports.CONFIDENCE_BANDS]
          + ["enriched", "valid", "ready"] + [f"cover_{i}" for i in range(len(reports.COVERED))]
          + [f"gap_{f}" for f in gaps.FIELDS])
MEASURES = ["n", *SUMS, "confidence", *COUNTS]
SCHEMA = ", ".join([f"{k} string" for k in KEYS if k != "dim"] + [f"{m} bigint" for m in MEASURES])


def _fact(dim: str, *values: Column) -> Column:
    filled = [*values, *[F.lit("")] * (4 - len(values))]
    return F.struct(F.lit(dim).alias("dim"), *[
        F.coalesce(v, F.lit("")).alias(k) for k, v in zip("abcd", filled)])


def _product_facts(scored: DataFrame, raw_columns: list[str], job: Column) -> DataFrame:
    optional = lambda c, kind: F.col(c) if c in scored.columns else F.lit(None).cast(kind)
    enriched = F.coalesce(optional("ai_enriched", "boolean"), F.lit(False))
    confidence = optional("ai_confidence", "double")
    tests = {
        **score.band_tests(F.col("quality_score")),
        **score.band_tests(confidence, reports.CONFIDENCE_BANDS),
        "enriched": enriched, "valid": F.col("validation_status") == "valid",
        "ready": F.col("quality_score") >= 70,
        **{f"cover_{i}": test() for i, (_, test) in enumerate(reports.COVERED)},
        **{f"gap_{f}": gaps.is_gap(f, raw_columns) for f in gaps.FIELDS}}
    measured = scored.select(
        job.cast("string").alias("job_id"), "category", "brand", "supplier", "source", "issues",
        F.lit(1).cast("bigint").alias("n"),
        *[F.round(F.col(s) * k).cast("bigint").alias(s) for s, k in SUMS.items()],
        F.when(enriched, F.round(confidence * CONFIDENCE).cast("bigint")).alias("confidence"),
        *[F.coalesce(tests[c], F.lit(False)).cast("bigint").alias(c) for c in COUNTS])
    facts = F.concat(
        F.array(_fact("all"), *[_fact(c, F.col(c)) for c in ("category", "brand", "supplier", "source")]),
        F.transform("issues", lambda i: _fact(
            "issue", i["severity"], i["issue_type"], i["field"], F.col("category"))))
    return measured.select("job_id", F.explode(facts).alias("fact"), *MEASURES).select(
        "job_id", "fact.*", *MEASURES)


def _row_facts(scored: DataFrame, job: Column, conflicts: DataFrame | None,
               clusters: DataFrame | None) -> DataFrame | None:
    """Facts of conflicts and cluster rows, with the job and supplier of their product."""
    parts = []
    if conflicts is not None:
        parts.append(conflicts.select("row_idx", F.lit("conflict").alias("dim"), F.col("severity").alias("a"),
                                      F.col("status").alias("b"), F.col("field").alias("c")))
    if clusters is not None:
        kind = F.when(F.col("row_idx") == F.col("centre"), F.lit("group")).otherwise(F.lit("redundant"))
        parts.append(clusters.select("row_idx", F.lit("cluster").alias("dim"), kind.alias("a"),
                                     F.lit("").alias("b"), F.lit("").alias("c")))
    if not parts:
        return None
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # Counted by row first: the join meets one row per product and kind.
    counted = rows.groupBy("row_idx", "dim", "a", "b", "c").agg(F.count(F.lit(1)).alias("n"))
    owner = scored.select("row_idx", job.cast("string").alias("job_id"), F.col("supplier").alias("d"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return counted.join(owner, "row_idx", "left").select(
        "job_id", "dim", *[blank(c) for c in "abcd"], "n")


def state(scored: DataFrame, raw_columns: list[str], job: Column | None = None,
          conflicts: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """The state of one batch: scored products (``issues`` included), its conflicts and cluster rows.

    The facts meet in one aggregate; conflicts and cluster rows are looked up once before it.
    """
    job = F.lit("") if job is None else job
    facts = _product_facts(scored, raw_columns, job)
    more = _row_facts(scored, job, conflicts, clusters)
    if more is not None:
        facts = facts.unionByName(more, allowMissingColumns=True)
    return merge(facts.withColumn("job_id", F.coalesce("job_id", F.lit(""))))


def merge(states: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """States, or facts, added up; fewer ``keys`` give a coarser state."""
    return states.groupBy(*keys).agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES])


def add_batch(state: DataFrame, folder: str, batch_id: int) -> None:
    """Stores the state of one batch; a batch that is sent again replaces itself."""
    state.write.mode("overwrite").partitionBy("dim").parquet(f"{folder}/batch_id={batch_id}")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All stored states; the folder of a dimension is read only by the reports that need it."""
    return spark.read.schema(f"{SCHEMA}, dim string, batch_id int").option(
        "recursiveFileLookup", "false").parquet(folder)


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """The states of all batches added up into one, in a new folder."""
    add_batch(merge(read(spark, folder)), target, 0)


# -- reports -------------------------------------------------------------------------------

def _of(states: DataFrame, dim: str, job_id: str | None) -> DataFrame:
    picked = states.where(F.col("dim") == dim)
    return picked if job_id is None else picked.where(F.col("job_id") == job_id)


def _sum(measure: str = "n") -> Column:
    return F.coalesce(F.sum(measure), F.lit(0))


def _mean(s: str, digits: int = 1) -> Column:
    """Mean of a score; dimensions in percent. NULL of no rows."""
    percent = 1 if s == "quality_score" else 100
    return F.round(F.try_divide(F.sum(s) * percent, F.sum("n") * SUMS[s]), digits)


def _count_where(test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))


def averages(states: DataFrame, job_id: str | None = None) -> DataFrame:
    return _of(states, "all", job_id).agg(*[_mean(s).alias(s) for s in SUMS])


def ai_confidence(states: DataFrame, job_id: str | None = None) -> DataFrame:
    return _of(states, "all", job_id).agg(F.round(F.try_divide(
        F.sum("confidence") * 100, F.sum("enriched") * CONFIDENCE), 1).alias("ai_confidence"))


def kpis(states: DataFrame, job_id: str | None = None) -> DataFrame:
    return beside(
        _of(states, "all", job_id).agg(_sum().alias("products_processed"),
                                       *[_mean(s).alias(s) for s in SUMS]),
        _of(states, "issue", job_id).agg(
            _sum().alias("total_validation_issues"),
            _count_where(F.col("b") == "missing_value").alias("missing_attributes")),
        _of(states, "conflict", job_id).agg(_sum().alias("conflicts_detected")),
        _of(states, "cluster", job_id).agg(
            _count_where(F.col("a") == "group").alias("duplicate_groups")))


def histogram(states: DataFrame, bands=None, job_id: str | None = None) -> DataFrame:
    return _of(states, "all", job_id).agg(*[_sum(name).alias(name) for name, _ in bands or score.BANDS])


def top_groups(states: DataFrame, dim: str, k: int, blank: str, quality: bool = True,
               job_id: str | None = None) -> DataFrame:
    """Top k categories, brands, suppliers or sources by count, ties by name."""
    more = [_mean("quality_score").alias("avg_quality")] if quality else []
    return _of(states, dim, job_id).groupBy(
        text.first_filled(F.col("a"), F.lit(blank)).alias("name")).agg(
        F.sum("n").alias("count"), *more).orderBy(F.desc("count"), "name").limit(k)


def issues_by_field(states: DataFrame, job_id: str | None = None) -> DataFrame:
    return _of(states, "issue", job_id).groupBy(F.col("c").alias("raw_field")).agg(
        F.sum("n").alias("count")).withColumn("field", text.field_label(F.col("raw_field"))).orderBy(
        F.desc("count"), "raw_field")


def issues_by_type(states: DataFrame, job_id: str | None = None) -> DataFrame:
    return _of(states, "issue", job_id).groupBy(text.title_label(F.col("b")).alias("type")).agg(
        F.sum("n").alias("count")).orderBy(F.desc("count"), "type")


def issues_by_severity(states: DataFrame, job_id: str | None = None) -> DataFrame:
    levels = ("high", "medium", "low")
    return _of(states, "issue", job_id).agg(
        *[_count_where(F.col("a") == s).alias(s) for s in levels],
        _count_where(F.col("a").isin(*levels)).alias("total"))


def biggest_problems(states: DataFrame, k: int = 10, job_id: str | None = None) -> DataFrame:
    names = [F.col(k).alias(n) for k, n in (("a", "severity"), ("b", "issue_type"), ("c", "field"))]
    return _of(states, "issue", job_id).groupBy(*names).agg(F.sum("n").alias("count")).orderBy(
        F.desc("count"), "severity", "issue_type", "field").limit(k)


def funnel(states: DataFrame, job_id: str | None = None) -> DataFrame:
    return reports.funnel_rows(beside(
        _of(states, "all", job_id).agg(_sum().alias("total"), *[
            _sum(m).alias(m) for m in ("enriched", "valid", "ready")]),
        _of(states, "cluster", job_id).agg(
            _count_where(F.col("a") == "redundant").alias("redundant"),
            _count_where(F.col("a") == "group").alias("groups"))))


def category_scores(states: DataFrame, job_id: str | None = None) -> DataFrame:
    return _of(states, "category", job_id).groupBy(
        text.first_filled(F.col("a"), F.lit("General")).alias("category")).agg(
        _mean("quality_score").alias("quality"), _mean("completeness_score").alias("completeness"),
        _mean("validity_score").alias("validity")).orderBy(F.desc("quality"), "category")


def source_scores(states: DataFrame, job_id: str | None = None) -> DataFrame:
    sources = _of(states, "source", job_id)
    ratio = lambda s: F.try_divide(F.sum(s), F.sum("n") * SUMS[s])
    per_source = sources.groupBy(text.first_filled(F.col("a"), F.lit("Catalog Source")).alias("name")).agg(
        F.sum("n").alias("product_count"), ratio("quality_score").alias("q"),
        ratio("completeness_score").alias("c"), ratio("validity_score").alias("v"))
    return reports.source_rows(per_source, sources.agg(F.sum("n").alias("total")).scalar())


def field_coverage(states: DataFrame, job_id: str | None = None) -> DataFrame:
    return reports.coverage_rows(_of(states, "all", job_id).agg(
        _sum().alias("total"), *[_sum(f"cover_{i}").alias(f"n{i}") for i in range(len(reports.COVERED))]))


def data_gaps(states: DataFrame, job_id: str | None = None) -> DataFrame:
    return gaps.gap_rows(_of(states, "all", job_id).agg(
        _sum().alias("total"), *[_sum(f"gap_{f}").alias(f"gap_{f}") for f in gaps.FIELDS]))


def least_complete_categories(states: DataFrame, job_id: str | None = None) -> DataFrame:
    means = _of(states, "category", job_id).groupBy(F.col("a").alias("category")).agg(
        _mean("completeness_score").alias("completeness"), F.sum("n").alias("product_count"))
    worst = _of(states, "issue", job_id).where("b = 'missing_value'").groupBy(
        F.col("d").alias("category"), F.col("c").alias("field")).agg(F.sum("n").alias("n")).groupBy(
        "category").agg(F.min(F.struct((-F.col("n")).alias("neg"), "field")).alias("w"))
    return means.join(worst, "category", "left").select(
        "category", "completeness", "product_count",
        F.coalesce("w.field", F.lit("")).alias("most_missing_field")).orderBy("completeness", "category")


def supplier_conflicts(states: DataFrame, job_id: str | None = None) -> DataFrame:
    found = _of(states, "conflict", job_id)
    total = found.agg(F.sum("n").alias("total")).scalar()
    return found.groupBy(F.col("d").alias("supplier")).agg(F.sum("n").alias("conflict_count")).select(
        "supplier", "conflict_count", text.percent(F.col("conflict_count") / total).alias("share_pct"),
    ).orderBy(F.desc("conflict_count"), "supplier")


def conflict_summary(states: DataFrame, job_id: str | None = None) -> DataFrame:
    pending = F.col("b") == "pending"
    return _of(states, "conflict", job_id).agg(
        _sum().alias("total"), *[_count_where(F.col("a") == s).alias(s) for s in ("high", "medium", "low")],
        _count_where(pending).alias("pending"), _count_where(~pending).alias("resolved"))
