"""Column profiles from all values, in one pass and in bounded space."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_rules import CATALOGUES
from tidyshelf.operators import mapping, profile


@pytest.mark.parametrize("prefix", [0, 20, 10_000])
def test_first_values_of_each_column(spark, prefix):
    rnd = random.Random(7)
    rows = [(i, str(rnd.randint(0, 400)), rnd.choice(["a", "b", " a ", "N/A", ""]), f"late{i}" if i > 900 else None, None)
            for i in range(1000)]
    df = spark.createDataFrame(rows, "row_idx long, many string, few string, late string, none string").repartition(5)
    got = {}
    for r in profile.first_distinct(df, k=6, prefix=prefix).orderBy("position", "rank").collect():
        got.setdefault(r["position"], []).append((r["value"], r["first_row"]))
    want = {}
    for p in range(4):
        seen = {}
        for r in rows:
            v = (r[p + 1] or "").strip()
            if v and v.lower() != "n/a":
                seen.setdefault(v, r[0])
        if seen:
            want[p] = list(seen.items())[:6]
    assert got == want


def test_a_telling_value_counts_wherever_it_stands(spark):
    rows = spark.range(1_000_001).select(
        F.col("id").alias("row_idx"), F.lit("plain").alias("Zed"),
        F.when(F.col("id") == 1_000_000, "24 VDC").otherwise(F.lit("n")).alias("Rating_x"))
    report = {r["original_column"]: r["canonical_field"] for r in mapping.analyze(rows, whole=True).collect()}
    assert report["Rating_x"] == "voltage"
    before = mapping.analyze(rows.where("row_idx < 1000000"), whole=True).collect()
    assert {r["original_column"]: r["canonical_field"] for r in before}["Rating_x"] != "voltage"
    counts = {r["column"]: r for r in profile.column_counts(rows).collect()}
    assert counts["Rating_x"]["n_values"] == 1_000_001 and counts["Rating_x"]["voltage"] == 1
    assert counts["Rating_x"]["distinct_values"] == 2


def test_whole_and_sampled_rules_agree_on_small_catalogues(spark):
    for row, want in CATALOGUES:
        df = spark.createDataFrame([(0, *row.values())], ["row_idx", *row])
        got = mapping.analyze(df, whole=True).orderBy("position").collect()
        assert [r["canonical_field"] for r in got] == want, row
        assert got == mapping.analyze(df).orderBy("position").collect()


def test_no_rows(spark):
    df = spark.createDataFrame([], "row_idx long, a string, `b c` string")
    got = mapping.analyze(df, whole=True).orderBy("position").collect()
    assert [r["original_column"] for r in got] == ["a", "b c"]
    assert profile.whole_profile(df).where("n_values = 0 AND size(samples) = 0").count() == 2
