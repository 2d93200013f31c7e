"""Search by index and pages by rank against the plain scans."""

import random

import pytest
from pyspark.sql import functions as F

from tidyshelf.operators import grid, pages, search_index

COLUMNS = ["a", "b"]
TERMS = ["abc", "ABCA", "a%c", "ab_a", "_", "%", "", "zz", "ca%ab%b", "\\", "b\\c", "é😀x", "😀", "İst", "ΑΣ", "cabcab", None]


def rows_of(seed, n):
    rnd = random.Random(seed)
    word = lambda: rnd.choice([None, "", "".join(rnd.choice("abcABC%_\\") for _ in range(rnd.randint(1, 12))),
                               rnd.choice(["É😀x y", "İstanbul", "ΟΔΟΣ ΑΣ", "b\\c\\"])])
    return [(i, word(), word()) for i in range(n)]


@pytest.mark.parametrize("few", [0, 10_000])
def test_index_finds_what_a_scan_finds(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(search_index, "FEW", few)
    rows = spark.createDataFrame(rows_of(1, 300), "row_idx long, a string, b string")
    index = str(tmp_path / "index")
    search_index.build(rows.where("row_idx < 200"), index, COLUMNS)
    for _ in range(2):   # a batch that is sent again replaces itself
        search_index.build(rows.where("row_idx >= 200"), index, COLUMNS, batch_id=1)
    for term in TERMS:
        want = sorted(r["row_idx"] for r in grid.search(rows, term, COLUMNS).collect())
        got = search_index.search(spark, index, term, COLUMNS)
        assert sorted(r["row_idx"] for r in got.collect()) == want, term


def test_lookup_reads_few_rows(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").alias("row_idx"), F.concat(F.lit("item "), F.col("id")).alias("a"))
    index = str(tmp_path / "index")
    search_index.build(rows, index, ["a"], ranges=20)
    found = search_index.search(spark, index, "4321", ["a"])
    plan = found._jdf.queryExecution().toString()
    assert [r["row_idx"] for r in found.collect()] == [4321] and "PushedFilters: [In(row_idx" in plan or "EqualTo(row_idx" in plan


@pytest.mark.parametrize("descending", [False, True])
def test_pages_follow_the_order(spark, tmp_path, descending):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, *range(9)]), f"t{i}") for i in range(997)]
    df = spark.createDataFrame(rows, "row_idx long, price int, t string").repartition(6)
    pages.store(df, str(tmp_path / "p"), "price", descending, range_rows=50)
    assert pages.page_info(spark, str(tmp_path / "p"), 30) == (997, 34)
    names, before = pages.starts(spark, str(tmp_path / "p"))
    assert len(names) > 10 and before[-1] == 997
    for number in (1, 2, 17, 33, 34, 35, 0):
        got = pages.page(spark, str(tmp_path / "p"), number, 30, "price", descending)
        want = grid.page(df, number, 30, "price", descending).collect() if number else []
        cells = [(r["row_idx"], r["price"], r["t"]) for r in got.orderBy("rank").collect()]
        assert cells == [tuple(r) for r in want]
        assert [r["rank"] for r in got.orderBy("rank").collect()] == list(range(
            (number - 1) * 30 + 1, (number - 1) * 30 + 1 + len(cells)))
        assert len({f.split("_range=")[1].split("/")[0] for f in got.inputFiles() if "_range=" in f}) <= 3


def test_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "row_idx long, a string, b string")
    pages.store(empty, str(tmp_path / "p"), "a")
    assert pages.page(spark, str(tmp_path / "p"), sort_by="a").count() == 0
    assert pages.page_info(spark, str(tmp_path / "p")) == (0, 0)
    search_index.build(empty, str(tmp_path / "i"), COLUMNS)
    assert search_index.search(spark, str(tmp_path / "i"), "abc", COLUMNS).count() == 0
