"""States of batches against the reports over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidyshelf.operators import report_states as rs
from tidyshelf.operators import reports

RAW = ["E1_Brand"]
SCORED = """row_idx long, category string, brand string, supplier string, source string, manufacturer string,
  power string, voltage string, ip_rating string, dimensions string, weight string, price double,
  technical_document string, product_url string, raw_data map<string, string>, validation_status string,
  issues array<struct<severity: string, issue_type: string, field: string>>, quality_score double,
  completeness_score double, validity_score double, consistency_score double,
  source_agreement_score double, ai_enriched boolean, ai_confidence double, n long"""
CONFLICTS = "row_idx long, severity string, status string, field string"
CLUSTERS = "row_idx long, centre long"


def rows_of(n, seed=3):
    rnd = random.Random(seed)
    # A third of the rows share one brand, supplier and category.
    word = lambda: "hot" if rnd.random() < 0.34 else rnd.choice([None, "", "a", "b", "N/A"])
    unit = lambda k: rnd.randint(0, k) / k
    issue = lambda: (rnd.choice(["high", "medium", "low"]), rnd.choice(["missing_value", "invalid_url"]),
                     rnd.choice(["price", "brand"]))
    return [(i, word(), word(), word(), word(), word(), word(), word(), word(), word(), word(),
             rnd.choice([None, -1.0, 0.0, 5.0]), word(), word(), rnd.choice([None, {"E1_Brand": "x"}]),
             rnd.choice(["valid", "warning"]), [issue() for _ in range(rnd.randint(0, 3))],
             rnd.randint(0, 1000) / 10, unit(1000), unit(1000), unit(1000), unit(1000),
             rnd.random() < 0.5, rnd.choice([None, 0.88, 0.75]), 99) for i in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    scored = spark.createDataFrame(rows_of(400), SCORED).cache()
    found = spark.createDataFrame(
        [(i % 400, ["high", "medium"][i % 2], ["pending", "accept_a"][i % 3 == 0], "power")
         for i in range(90)], CONFLICTS)
    clusters = spark.createDataFrame([(i, i - i % 4) for i in range(0, 80)], CLUSTERS)
    return scored, found, clusters


def listed(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def batch(tables, test, job=None):
    scored, found, clusters = (t.where(test) for t in tables)
    return rs.state(scored, RAW, job, found, clusters)


def test_batches_in_any_split_add_up(spark, tables, tmp_path):
    whole = listed(batch(tables, F.lit(True)))
    folder = str(tmp_path / "states")
    tests = [F.col("row_idx") < 10, F.col("row_idx") >= 300, F.col("row_idx").between(10, 299)]
    for i, test in enumerate(tests):
        rs.add_batch(batch(tables, test), folder, i)
    assert listed(rs.merge(rs.read(spark, folder))) == whole
    rs.add_batch(batch(tables, tests[1]), folder, 1)   # sent again
    assert listed(rs.merge(rs.read(spark, folder))) == whole
    rs.compact(spark, folder, str(tmp_path / "one"))
    assert listed(rs.read(spark, str(tmp_path / "one")).drop("batch_id")) == whole


def test_reports_equal_those_over_rows(spark, tables, tmp_path):
    scored, found, clusters = tables
    folder = str(tmp_path / "states")
    for i in range(2):
        rs.add_batch(batch(tables, F.col("row_idx") % 2 == i), folder, i)
    states = rs.read(spark, folder)
    issues = scored.select("row_idx", F.inline("issues"))
    for mine, theirs in [
            (rs.histogram(states), reports.quality_histogram(scored)),
            (rs.histogram(states, reports.CONFIDENCE_BANDS), reports.confidence_histogram(scored)),
            (rs.issues_by_field(states), reports.issues_by_field(issues)),
            (rs.issues_by_type(states), reports.issues_by_type(issues)),
            (rs.issues_by_severity(states), reports.issues_by_severity(issues)),
            (rs.biggest_problems(states), reports.biggest_problems(issues)),
            (rs.funnel(states), reports.funnel(scored, clusters)),
            (rs.field_coverage(states), reports.field_coverage(scored)),
            (rs.top_groups(states, "category", 10, "Uncategorized", False),
             reports.category_distribution(scored))]:
        assert listed(mine) == listed(theirs)
    # Means are held against exact sums: the plain reports add doubles up in any order.
    rows = scored.collect()
    exact = round(sum(round(r["quality_score"] * 10) for r in rows) / 10 / len(rows), 1)
    assert rs.averages(states).first()["quality_score"] == pytest.approx(exact, abs=0.1001)
    assert rs.conflict_summary(states).first()["total"] == found.count()
    hot = [r for r in rows if r["brand"] == "hot"]
    assert {r["name"]: r["count"] for r in rs.top_groups(states, "brand", 9, "Unknown").collect()}["hot"] == len(hot)


def test_jobs_are_told_apart(spark, tables):
    states = batch(tables, F.lit(True), F.col("source"))
    scored = tables[0]
    for job in ("hot", "a"):
        assert listed(rs.histogram(states, job_id=job)) == listed(
            reports.quality_histogram(scored.where(F.col("source") == job)))


def test_one_aggregate_and_only_the_dimension_is_read(spark, tables, tmp_path):
    state = rs.state(tables[0], RAW)
    plan = state._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.count("Generate") == 1 and "Join" not in plan
    folder = str(tmp_path / "states")
    rs.add_batch(state, folder, 0)
    plan = rs.issues_by_type(rs.read(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dim" in plan and "issue" in plan


def test_empty_tables(spark):
    empty = rs.state(spark.createDataFrame([], SCORED), RAW, None, spark.createDataFrame([], CONFLICTS),
                     spark.createDataFrame([], CLUSTERS))
    assert empty.count() == 0
    kpis = rs.kpis(empty).first()
    assert kpis["products_processed"] == 0 and kpis["quality_score"] is None
    assert kpis["total_validation_issues"] == 0 and kpis["duplicate_groups"] == 0
    assert {r["count"] for r in rs.funnel(empty).collect()} == {0}
    assert rs.source_scores(empty).count() == 0 and rs.supplier_conflicts(empty).count() == 0
