"""Row work over narrow files: rows a task, and cells read once."""

from tidyshelf.operators import conflicts
from tidyshelf.operators.normalize import normalize
from tidyshelf.session import cut, spread


def test_brand_feeds_are_read_once_a_row(spark):
    raw = spark.createDataFrame(
        [(0, "Acme", "-- unbranded --", "Zed"), (1, "Acme", " acme ", "N/A"), (2, "", "Zed", "Acme")],
        "row_idx long, Brand_Name string, E1_Brand string, Unilog_Brand string")
    columns = ["Brand_Name", "E1_Brand", "Unilog_Brand"]
    clean = cut(normalize(raw, {c: "brand" for c in columns}))
    found = conflicts.brand_conflicts(clean, columns)
    feeds = conflicts.brand_feed_columns(columns)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_contains_key") + plan.count("array_contains(map_keys") == len(feeds)
    assert [(r["row_idx"], r["value_a"], r["value_b"]) for r in found.orderBy("row_idx").collect()] == [
        (0, "Zed", "Acme"), (2, "Acme", "Zed")]


def test_rows_of_a_narrow_file_are_dealt_out(spark, tmp_path):
    spark.range(120_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    narrow = spark.read.parquet(str(tmp_path / "t"))
    assert narrow.rdd.getNumPartitions() == 1
    sizes = spread(narrow, "id", rows=20_000).rdd.glom().map(len).collect()
    assert len(sizes) >= 6 and sum(sizes) == 120_000 and max(sizes) < 24_000
    assert spread(spark.range(900), "id").rdd.getNumPartitions() == spark.range(900).rdd.getNumPartitions()
