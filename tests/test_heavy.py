"""Joins with heavy keys against the plain ones; where their rows end up."""

import statistics

import pytest
from pyspark.sql import functions as F

from tidyshelf.operators import conflicts, duplicates, enrich, heavy


def listed(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def sides(spark):
    key = F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 20 == 1, F.lit(None)).when(
        F.col("id") % 20 == 3, F.lit("gone")).otherwise(F.concat(F.lit("k"), F.col("id") % 900))
    left = spark.range(60_000).select(F.col("id").alias("row_idx"), key.alias("k"), F.lit(1).alias("g"))
    right = left.where("k is null or k <> 'gone'").groupBy("k", "g").agg(F.max("row_idx").alias("v"))
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("on", [["k"], ["k", "g"]])
def test_equals_the_plain_join(sides, how, on):
    left, right = sides
    right = right.select(*on, "v")
    assert listed(heavy.join(left, right, on, ["row_idx"], how)) == listed(left.join(right, on, how))


@pytest.fixture
def shuffled(spark):
    """No broadcast, and tasks as they are planned."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def loads(df):
    n = {r[0]: r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()}
    return [n.get(i, 0) for i in range(16)]


def test_no_task_has_twice_the_median(shuffled, sides):
    left, right = sides
    plain = loads(left.join(right.select("k", "v"), "k", "left"))
    assert max(plain) > 5 * statistics.median(plain)
    mine = loads(heavy.join(left, right.select("k", "v"), ["k"], ["row_idx"], "left"))
    assert sum(mine) == sum(plain) and max(mine) <= 2 * statistics.median(mine)


def test_few_rows_are_repeated(spark, sides):
    left, right = sides
    found = left.limit(1).select(heavy.salts(left, ["k"], 16).alias("m")).first()["m"]
    assert len(found) == 3   # hot, none and gone
    assert sum(found.values()) <= 16 * heavy.PIECES


def test_wrong_keys_are_refused(spark):
    a = spark.createDataFrame([(1, 1.0)], "row_idx int, k double")
    with pytest.raises(ValueError, match="exact"):
        heavy.join(a, a, ["k"], ["row_idx"])
    with pytest.raises(ValueError, match="exact"):
        heavy.join(a, spark.range(1).select(F.col("id").alias("row_idx")), ["row_idx"], ["row_idx"])
    with pytest.raises(ValueError, match="how"):
        heavy.join(a, a, ["row_idx"], ["row_idx"], "full")


def test_empty_sides(spark, sides):
    left, right = sides
    assert heavy.join(left.limit(0), right, ["k"], ["row_idx"], "left").count() == 0
    assert heavy.join(left, right.limit(0), ["k", "g"], ["row_idx"], "left").count() == left.count()


# -- the operators that use it, with one key holding half the rows ------------------------------

def test_enrichment_once_per_key(shuffled, sides):
    left, _ = sides
    products = left.withColumn("product_id", F.col("row_idx"))
    enricher = lambda df: df.select("row_idx", "product_id", F.length("k").alias("size"))
    done = enrich.enrich_once_per_key(products, enricher, F.coalesce("k", F.lit("")))
    assert listed(done) == listed(enricher(products))
    n = loads(done)
    assert max(n) <= 2 * statistics.median(n)


def test_conflicts_per_product(shuffled, sides):
    left, _ = sides
    products = left.select("row_idx", F.col("row_idx").alias("product_id"), F.col("k").alias("model_number"))
    found = products.where("row_idx % 11 = 0 and row_idx < 5000")
    done = conflicts.counts_per_product(products, found)
    rows = [r for r in found.collect()]
    by_model, own = {}, {r["row_idx"] for r in rows}
    for r in rows:
        if r["model_number"] is not None:
            by_model[r["model_number"]] = by_model.get(r["model_number"], 0) + 1
    for r in done.collect():
        m = r["model_number"]
        # By its model, and by its own row where that has no model.
        assert r["conflict_count"] == by_model.get(m, 0) + (m is None and r["row_idx"] in own)
    n = loads(done)
    assert sum(n) == 60_000 and max(n) <= 2 * statistics.median(n)


def test_members_of_a_cluster_that_holds_half(shuffled, spark):
    rows = spark.range(4000).select(
        F.col("id").alias("row_idx"), F.col("id").cast("string").alias("product_id"),
        F.lit("Pump").alias("product_name"), F.lit("B").alias("brand"), F.lit("C").alias("category"),
        F.when(F.col("id") % 2 == 0, F.lit("M-1")).otherwise(F.concat(F.lit("N"), F.floor(F.col("id") / 8)))
        .alias("model_number"), F.lit("").alias("mpn"), F.lit("s").alias("source"),
        F.when(F.col("id") % 3 == 0, F.lit("5 kW")).otherwise(F.lit("6 kW")).alias("power"),
        F.lit("").alias("voltage"), F.lit(1.0).alias("price"))
    clusters = duplicates.cluster_by_model(rows)
    assert {tuple(r) for r in clusters.collect()} == {
        (i, 0 if i % 2 == 0 else i - i % 8 + 1) for i in range(4000)}
    items = duplicates.duplicate_items(rows, clusters)
    assert items.count() == 4000
    found = conflicts.spec_conflicts(rows, clusters, "all")
    assert found.where("field = 'power'").count() == found.count() > 400
