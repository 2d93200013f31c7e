"""Files in, tables and exports out; streams; selected queries next to their twins."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.check_twins import compare, connect
from tests.test_duplicates import greedy
from tidyshelf import fixed_values as fv
from tidyshelf.operators import duplicates, grid, mapping
from tidyshelf.plans import part_catalog, pipeline
from tidyshelf.sources import catalog, sinks
from tidyshelf.sources.generate import COLUMNS, generate_catalog
from tidyshelf.streaming import feed, progress

SF = "/root/testdata/sf0.001"


def test_read_catalog(spark, tmp_path):
    path = tmp_path / "messy.txt"
    path.write_text("﻿Id ; Name;Id\n1; a, b ;2\n3;\"x;y\"\n\n4;z;5;6\n", encoding="utf-8")
    rows = catalog.read_catalog(spark, str(path)).orderBy("row_idx").collect()
    assert [(r["Name"], r["Id"], r["row_idx"]) for r in rows] == [
        ("a, b", "2", 0), ("x;y", "", 1), ("z", "5", 2)]
    latin = tmp_path / "latin.csv"
    latin.write_bytes("Id,Ort\n1,Köln\n".encode("latin-1"))
    assert catalog.read_catalog(spark, str(latin)).first()["Ort"] == "Köln"


def test_headers_by_position(spark, tmp_path):
    path = tmp_path / "headers.csv"
    path.write_text("Id,Name,Id,,Price__dup_rate,NAME\n1,a,2,x,3,A\n4,b,5,y,6,B\n")
    df = catalog.read_catalog(spark, str(path))
    assert df.columns == ["Name_1", "Id", "Price__dup_rate", "NAME", "row_idx"]
    assert [tuple(r) for r in df.orderBy("row_idx").collect()] == [
        ("a", "2", "3", "A", 0), ("b", "5", "6", "B", 1)]
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    assert catalog.read_catalog(spark, str(empty)).count() == 0


def test_delimiter_is_judged_on_all_lines(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_text("a,b;c,d\n" + "1,2;3,4\n" * 100 + "1;2\n" * 900)
    assert catalog.read_catalog(spark, str(path)).columns == ["a,b", "c,d", "row_idx"]
    folder = tmp_path / "several"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\n1,2\n")
    (folder / "2.csv").write_text("\n a, b\n3,4\n")
    rows = catalog.read_catalog(spark, str(folder)).orderBy("row_idx").collect()
    assert [tuple(r) for r in rows] == [("1", "2", 0), ("3", "4", 1)]
    (folder / "3.csv").write_text("b;a\n5;6\n")
    with pytest.raises(ValueError):
        catalog.read_catalog(spark, str(folder))


def test_row_numbers_follow_the_files(spark, tmp_path):
    spark.range(5000).repartitionByRange(7, "id").write.parquet(str(tmp_path / "t"))
    df = catalog.with_row_idx(spark.read.parquet(str(tmp_path / "t")))
    assert df.where("id <> row_idx").count() == 0 and df.count() == 5000


def test_job_end_to_end(spark, tmp_path):
    source, root = str(tmp_path / "feed.csv"), str(tmp_path / "tables")
    generate_catalog(spark, 300, 30, 60).orderBy("row_idx").select(COLUMNS).coalesce(1).write.option(
        "header", True).option("escape", '"').csv(source)
    for job in ("1", "2", "2"):
        record = pipeline.process_file(spark, source, root, job).first()
    assert record["total_rows"] == 300 and record["status"] == "completed"
    table = lambda name: sinks.read_table(spark, root, name)
    products = catalog.newest_job_rows(table("products"), table("jobs"))
    assert products.count() == 300 and products.select("job_id").distinct().collect() == [("2",)]
    assert table("products").count() == 600 and table("jobs").count() == 2
    assert table("duplicate_groups").count() > 0 and table("conflicts").count() > 0
    items = catalog.job_scan(table("duplicate_items"), "2")
    assert items.count() == items.select("row_idx").distinct().count()
    enrichment = catalog.job_scan(table("enrichment"), "2")
    sinks.write_csv(sinks.catalog_export(products, enrichment), str(tmp_path / "out"), True)
    out = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert out.columns == [n for n, _ in fv.EXPORT_COLUMNS] and out.count() == 300
    page, info, facets = grid.grid(products, term="motor", sort_by="price", descending=True)
    prices = [r["price"] for r in page.collect()]
    assert len(prices) == 25 and prices == sorted(prices, key=lambda p: p or 0, reverse=True)
    assert info.first()["total"] >= 25 and facets["category"].count() == 10


def test_feed_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = generate_catalog(spark, 40).select(COLUMNS)
    # each line twice in its file: equal lines are rows of their own
    rows.union(rows).coalesce(1).write.option("header", True).csv(source)
    for _ in range(2):
        raw = feed.read_feed(spark, source, COLUMNS)
        feed.start_feed(raw, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    landed = spark.read.parquet(str(tmp_path / "out"))
    assert landed.count() == 80 and landed.where("quality_score is null").count() == 0
    assert sorted(r["row_idx"] for r in landed.select("row_idx").collect()) == list(range(80))
    grouped = duplicates.duplicate_items(landed, duplicates.cluster(landed))
    assert grouped.select("row_idx").distinct().count() == 80


def test_windowed_stream_equals_batch(spark, tmp_path):
    events = spark.range(600).select(
        F.timestamp_seconds(F.col("id") * 37).alias("ts"), (F.col("id") % 3).alias("kind"))
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = progress.windowed_counts(stream, "kind").writeStream.format("memory").queryName(
        "windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = progress.windowed_counts(spark.read.parquet(str(tmp_path / "e")), "kind")
    assert sorted(spark.table("windows").collect()) == sorted(batch.collect())


def test_whole_fingerprint_is_of_the_multiset_of_rows(spark):
    def of(rows):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_idx long, a string, b string")
        return tuple(mapping.whole_fingerprint(df).first())

    rows = [(f"x{i % 40}", f"y{i}") for i in range(100)]
    base = of(rows)
    assert of(rows[::-1]) == base
    changed = [rows[:-1], [*rows, rows[3]], [*rows[:50], ("x", "y"), *rows[51:]], [(b, a) for a, b in rows],
               [(a + b[:1], b[1:]) for a, b in rows]]
    assert len({base, *map(of, changed)}) == 1 + len(changed)
    assert of([]) != of([("", "")])


def test_latest_state_of_each_key(spark):
    rows = [(1, "a", 5, 0), (1, "a", 7, 2), (2, "a", 1, 1), (1, "b", None, 0)]
    landed = spark.createDataFrame(rows, "window int, key string, n int, batch_id long")
    got = progress.latest(landed, "window", "key")
    assert sorted(map(tuple, got.collect())) == [(1, "a", 7), (1, "b", None), (2, "a", 1)]


def test_whole_job_follows_the_greedy_rule(spark):
    rows = [tuple(r) for r in part_catalog.products(spark, SF).select(
        "row_idx", "product_name", "brand", "category", "model_number").orderBy("row_idx").collect()]
    got = {r["row_idx"]: r["centre"] for r in entry.queries()["whole_job"](spark, SF).collect()}
    assert set(got) == {r[0] for r in rows}
    assert {k: v for k, v in got.items() if v is not None} == greedy(rows, duplicates.THRESHOLD)


QUICK = ["feed_clusters", "csv_roundtrip", "csv_multiline", "csv_mixed_encodings", "catalogue_fingerprints", "name_clusters", "name_cluster_members",
         "name_cluster_groups", "table_roundtrip", "windowed_events_stream", "conflict_export",
         "normalized_products", "validation_issues", "model_clusters", "conflicts", "row_scores",
         "catalog_export", "job_progress", "products_after_resolution"]


@pytest.mark.parametrize("name", list(entry.queries()) if os.environ.get("ALL_QUERIES") else QUICK)
def test_query_matches_its_twin(spark, name):
    ok, rows, note = compare(spark, connect(SF), SF, name, entry.queries()[name],
                             entry.oracle_sql().get(name))
    assert ok and rows > 0, note


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
