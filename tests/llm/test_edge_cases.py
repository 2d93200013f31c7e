"""Every operator and stage on nulls, empty and long texts, repeats, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidyshelf.llm import (decontaminate, language_id, license_scan, packing, quality_rules,
                           secret_scan, simhash, suffix_dedup, toxicity, url_filters)
from tidyshelf.llm.queries import new_ledger

LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(20_000))
CLASH = ["score", "kept", "doc", "node", "fp", "spans", "row", "id", "blob", "hit", "words", "rule",
         "host", "held_out", "digest", "_id", "_trusted", "label"]
ROWS = [(0, None), (1, ""), (2, " \n\t "), (3, "Ünïcödé ☃ 😀 words"), (4, "same text twice here"),
        (5, "same text twice here"), (5, "same text twice here"), (None, "no id"), (None, None),
        (6, LONG), (7, "token = 'abcdef123' and 0123456789abcdef0123456789"), (8, "x" * 5000)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"{c} string" for c in CLASH)


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en" if i and i % 2 else None, None, len(t or ""), *["?"] * len(CLASH)) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0, "?"), (6, 1, None, "?"), (None, 1, 1, "?"), (99, 0, 1, "?"),
                                  (8, None, 1, "?"), (3, 1, 0, "?")],
                                 "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "same text twice here"), (1, "same text twice here"), (2, None),
                                  (3, ""), (None, "no id")], "item_id long, text string")


def operators(spark, labels, items):
    return {
        "op1": lambda d: suffix_dedup.repeats(d),
        "op2": lambda d: toxicity.toxicity(d, labels),
        "op3": lambda d: packing.pack(d),
        "op5": lambda d: license_scan.license_scan(d),
        "op6": lambda d: quality_rules.quality_rules(d, labels),
        "op7": lambda d: secret_scan.scan(d, new_ledger(spark)),
        "op8": lambda d: simhash.near_duplicates(d),
        "op9": lambda d: decontaminate.scan(d, items),
        "op10": lambda d: language_id.predict(d),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_operators(spark, docs, labels, items, name):
    run = operators(spark, labels, items)[name]
    rows = run(docs).collect()
    ids = sorted(str(r.doc_id) for r in rows)
    if name == "op3":
        assert set(ids) == {str(i) for i, _ in ROWS}
        assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    else:
        assert ids == sorted(str(i) for i, _ in ROWS)
    assert run(frame(spark, [])).collect() == []


def test_pages(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.COM/en/x?y#z"), (4, "http://a.com"),
            (None, "ftp://x.net/fr/"), (5, "a\nb://c.com/\n?q")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, host string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.url_filter(
        pages, [("com", "/", "allow"), ("example.com", "/en/", "block"), ("net", "/fr/", "block")]).collect()}
    assert got == {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
                   (4, "a.example.com", "/en/x", "example.com/en/", "block"),
                   (4, "a.com", "", None, "allow"), (None, "x.net", "/fr/", "net/fr/", "block"),
                   (5, "c.com", "/\n", "com/", "allow")}
    assert url_filters.url_filter(pages.limit(0), [("com", "/", "allow")]).collect() == []
    assert {r.verdict for r in url_filters.url_filter(pages, [], "block").collect()} == {"block"}


def test_stages(spark, docs, labels, items, tmp_path):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    items.withColumn("text", F.lit("same text twice here")).write.parquet(f"{folder}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.collect()
        assert stage(spark, frame(spark, []), folder).collect() == []
    kept = sorted(str(r.doc_id) for r in corpus_pipeline.near_copies(spark, docs, folder).collect())
    assert kept == ["0", "3", "4", "6", "7", "8", "None", "None"]
    clean = {r.text for r in corpus_pipeline.benchmark(spark, docs, folder).collect()}
    assert "same text twice here" not in clean and LONG in clean
    masked = [r.text for r in corpus_pipeline.secrets(spark, docs, folder).collect() if r.doc_id == 7]
    assert masked == ["[secret]' and [secret]"]
