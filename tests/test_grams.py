"""Grams of a value: split once, whatever its length."""

from pyspark.sql import functions as F

from tidyshelf.operators import search_index


def test_a_value_is_split_once(spark):
    rows = spark.createDataFrame([(None,), ("",), ("aB",), ("abCabc",), ("é😀xY",)], "v string").coalesce(1)
    found = rows.select("v", search_index.grams(F.col("v")).alias("g"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 1
    got = {r["v"]: r["g"] for r in found.select("v", F.coalesce("g", F.array().cast("array<string>")).alias("g")).collect()}
    assert got == {None: [], "": [], "aB": [], "abCabc": ["abc", "bca", "cab"], "é😀xY": ["é😀x", "😀xy"]}


def test_long_values_are_no_square(spark):
    long = spark.range(4).select(F.repeat(F.lit("abcdefghij"), 5000).alias("v"))
    assert [r["n"] for r in long.select(F.size(search_index.grams(F.col("v"))).alias("n")).collect()] == [10] * 4
