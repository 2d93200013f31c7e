"""The ledger scans what it does not know, and nothing twice."""

import random

from pyspark.sql import functions as F

from tidyshelf.llm import queries, secret_scan

FOLDER = "/root/testdata/sf0.001"


def cells(df):
    return sorted(map(tuple, df.select("doc_id", secret_scan.as_text(F.col("spans")).alias("s")).collect()))


def test_seeded_ledger_gives_what_a_new_one_gives(spark):
    docs = queries.table(spark, FOLDER, "documents")
    whole = secret_scan.scan(docs, queries.new_ledger(spark)).select(
        "doc_id", secret_scan.as_text(F.col("spans")).alias("spans"))
    seeded = queries.op7_secret_scans(spark, FOLDER).select("doc_id", "spans")
    assert sorted(whole.collect()) == sorted(seeded.collect())


def test_each_blob_and_rule_is_read_once(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    key = "ghp_" + "z9" * 20
    rows = [(i, f"version {i} token = abcdef{i}") for i in range(20)] + [(90, None), (91, f"x {key}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    secret_scan.update(docs.where("doc_id < 10 OR doc_id = 91"), ledger, secret_scan.RULES[:-1])
    first = cells(secret_scan.scan(docs, ledger))
    again = cells(secret_scan.scan(docs.union(docs), ledger))
    assert sorted(first * 2) == again and (91, "forge:2:46") in first and (90, "") in first
    read = spark.read.parquet(f"{ledger}/blobs").select("blob", F.explode("rules").alias("rule"))
    assert read.count() == read.distinct().count() == 22 * len(secret_scan.RULES)
    found = spark.read.parquet(f"{ledger}/findings")
    assert found.count() == found.distinct().count() == 21
    # a later version of a path is a blob of its own; the earlier one stays in the ledger
    later = spark.createDataFrame([(3, "version 3 without")], "doc_id long, text string")
    assert cells(secret_scan.scan(later, ledger)) == [(3, "")]
    assert cells(secret_scan.scan(docs.where("doc_id = 3"), ledger)) == [r for r in first if r[0] == 3]


def test_tight_patterns_move_no_match(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["a1b2c3d4", "f" * 23, "0" * 24, "g", " ", "é"]) for _ in range(30)) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    loose = tuple(secret_scan.Rule(r.kind, r.pattern, r.least, r.group, r.needle) for r in secret_scan.RULES)
    tight, plain = (cells(secret_scan.scan(docs, queries.new_ledger(spark), rules))
                    for rules in (secret_scan.RULES, loose))
    assert tight == plain and any(s for _, s in tight)
