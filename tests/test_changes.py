"""Decisions and renewed enrichments on a stored job."""

import pytest
from pyspark.sql import functions as F

from tidyshelf.operators import detail, enrich, score
from tidyshelf.plans import changes, pipeline
from tidyshelf.plans import part_catalog as pc
from tidyshelf.sources import catalog, sinks

SF = "/root/testdata/sf0.001"
TABLES = ["products", "validation_issues", "conflicts", "duplicate_groups", "enrichment"]


def listed(df):
    names = sorted(df.columns)
    return sorted(repr(tuple(r[c] for c in names)) for r in df.collect())


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("job"))
    some = pc.raw(spark, SF).where("row_idx < 120")
    result = pipeline.run(some, pc.MAPPING, enrich_limit=60)
    for job in ("7", "8"):
        pipeline.save(result, folder, job)
        sinks.write_table(sinks.job_record(spark, job, "part", 0, "completed", {"message": "m"}, 120), folder, "jobs")
    return folder


def test_decisions_are_stored_and_scored_once(spark, root):
    other = {t: listed(catalog.job_scan(sinks.read_table(spark, root, t), "8")) for t in TABLES}
    found = changes.table(spark, root, "conflicts", "7")
    n_found = found.count()
    picked = found.where("field = 'brand'").orderBy("row_idx").limit(4).collect()
    acts = ["accept_b", "accept_a", "keep_for_review", "no such action"]
    actions = spark.createDataFrame(
        [(r["row_idx"], r["field"], a, None, t) for r, act in zip(picked, acts)
         for a, t in (("keep_for_review" if act == "accept_b" else act, 1), (act, 2))],
        "row_idx long, field string, action string, notes string, acted_at int")
    before = {r["row_idx"]: r for r in changes.table(spark, root, "products", "7").collect()}
    columns = changes.table(spark, root, "products", "7").columns
    for _ in range(2):   # sent again: nothing changes any more
        changes.decide_conflicts(spark, root, "7", actions)
        after = {r["row_idx"]: r for r in changes.table(spark, root, "products", "7").collect()}
        assert len(after) == len(before) == 120 and list(after[1].asDict()) == columns
        assert after[picked[0]["row_idx"]]["brand"] == picked[0]["value_b"]
        assert after[picked[1]["row_idx"]]["brand"] == picked[1]["value_a"]
        assert after[picked[2]["row_idx"]]["brand"] == before[picked[2]["row_idx"]]["brand"]
        status = {(r["row_idx"], r["field"]): r["status"]
                  for r in changes.table(spark, root, "conflicts", "7").collect()}
        assert [status[r["row_idx"], "brand"] for r in picked] == [*acts[:3], "pending"]
        assert len(status) == n_found
    # A row is in agreement again exactly when no open conflict names it.
    open_rows = {x for r in changes.table(spark, root, "conflicts", "7").collect()
                 if r["status"] not in changes.SETTLED for x in (r["row_idx"], r["other_row_idx"])}
    for i, r in after.items():
        assert (r["source_agreement_score"] == 1.0) == (i not in open_rows)
    stats = changes.table(spark, root, "jobs", "7").first()["stats"]
    mean = changes.table(spark, root, "products", "7").agg(*score.mean_scores()).first()
    assert stats["message"] == "m" and float(stats["quality_score"]) == mean["quality_score"]
    assert {t: listed(catalog.job_scan(sinks.read_table(spark, root, t), "8")) for t in TABLES} == other


def test_chosen_products_are_enriched_anew(spark, root):
    chosen = spark.createDataFrame([(5,), (100,), (100,), (9999,)], "row_idx long")
    half = lambda df: enrich.enrich(df).withColumn("confidence_score", F.lit(0.5))
    for _ in range(2):
        changes.reenrich(spark, root, "7", chosen, half)
        sure = {r["row_idx"]: r["confidence_score"]
                for r in changes.table(spark, root, "enrichment", "7").collect()}
        assert sure[5] == sure[100] == 0.5 and sure[6] != 0.5
        assert set(sure) == {*range(60), 100}
        marks = {r["row_idx"]: (r["ai_enriched"], r["ai_confidence"])
                 for r in changes.table(spark, root, "products", "7").collect()}
        assert marks[100] == (True, 0.5) and marks[101] == (False, 0.0) and len(marks) == 120
    assert changes.table(spark, root, "jobs", "7").first()["stats"]["ai_enriched_count"] == "61"


def test_group_decisions(spark, root):
    codes = [r["group_code"] for r in changes.table(spark, root, "duplicate_groups", "7").collect()]
    actions = spark.createDataFrame([(codes[0], "merge", "same", 1)],
                                    "group_code string, action string, notes string, acted_at int")
    changes.decide_groups(spark, root, "7", actions)
    got = {r["group_code"]: (r["status"], r["resolution_notes"])
           for r in changes.table(spark, root, "duplicate_groups", "7").collect()}
    assert got.pop(codes[0]) == ("merged", "same")
    assert set(got) == set(codes[1:]) and all(v == ("pending", None) for v in got.values())


def test_payload_of_the_detail(spark):
    fields = "row_idx long, category string, subcategory string, brand string, power string, voltage string, " \
             "ip_rating string, description string, product_name string, model_number string, p map<string, string>"
    rows = [(1, "c", "", "b", "", "", "", "d", "n", "m",
             {"category": "C", "attributes": '{"Power": "5 kW"}', "commerce_keywords": '["k"]',
              "confidence_score": "0.953"}),
            (2, "c", "", "b", "", "", "", "", "n", "m", {"brand": "B", "attributes": "torn {", "confidence_score": "95.25"}),
            (3, "c", "", "b", "", "", "", "", "n", "m", {}), (4, "c", "", "b", "", "", "", "", "n", "m", None)]
    products = spark.createDataFrame(rows, fields)
    none = enrich.enrich(pc.products(spark, SF)).limit(0)
    got = {r["row_idx"]: r["ai_intelligence"] for r in detail.enrichment_view(products, none, "p").collect()}
    assert got[1]["category"] == "C" and got[1]["attributes"] == {"Power": "5 kW"} and got[1]["confidence"] == 95.3
    assert got[1]["keywords"] == ["k"] and got[1]["description"] == "d" and got[1]["subcategory"] == "General"
    assert got[2]["brand"] == "B" and got[2]["attributes"] == {} and got[2]["confidence"] == 95.3
    assert got[3] == got[4] and got[3]["attributes"]["Power"] == "Standard"
