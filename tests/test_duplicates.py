"""Clusters against the sequential greedy rule."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.test_similarity import partial, ratio
from tidyshelf.operators import duplicates
from tidyshelf.session import number_rows

FIELDS = "row_idx long, product_name string, brand string, category string, model_number string"


def key(s):
    return re.sub("[^a-zA-Z0-9]", "", s).lower()


def similarity(a, b):
    if key(a[4]) and key(a[4]) == key(b[4]):
        return 0.95 if key(a[2]) == key(b[2]) or not key(a[2]) or not key(b[2]) else 0.85
    x, y = a[1].lower(), b[1].lower()
    if not x or not y:
        return 0.0
    value = 0.7 * ratio(" ".join(sorted(x.split())), " ".join(sorted(y.split()))) \
        + 0.3 * partial(x, y)
    if key(a[2]) and key(a[2]) == key(b[2]) and key(a[3]) == key(b[3]):
        value = min(1.0, value * 1.08)
    return round(value, 3)


def blocks(r):
    out = {("bc", key(r[2])[:6], key(r[3])[:6])}
    return out | {("m", key(r[4])[:5])} if key(r[4]) else out


def greedy(rows, threshold):
    taken, out = set(), {}
    for a in rows:
        if a[0] in taken:
            continue
        near = [b for b in rows if b[0] > a[0] and b[0] not in taken and blocks(a) & blocks(b)
                and similarity(a, b) >= threshold]
        for r in [a, *near]:
            taken.add(r[0])
            if near:
                out[r[0]] = a[0]
    return out


def catalogue(seed, n):
    rnd = random.Random(seed)
    words = ["motor", "pump", "valve", "heavy", "duty", "steel", "mini", "servo"]
    return [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 4))),
             rnd.choice(["Acme", "acme", "Acme Corp", "", "Zed"]), rnd.choice(["Pumps", "Motors"]),
             rnd.choice(["", "", f"M-{rnd.randint(1, 30)}", f"AB{rnd.randint(100, 999)}-7"]))
            for i in range(n)]


@pytest.mark.parametrize("seed,n,batch", [(1, 60, 2), (2, 120, 8)])
def test_clusters_follow_the_greedy_rule(spark, seed, n, batch):
    rows = catalogue(seed, n)
    df = spark.createDataFrame(rows, FIELDS)
    got = {r["row_idx"]: r["centre"] for r in duplicates.cluster(df, 0.8, batch).collect()}
    assert got == greedy(rows, 0.8)


def test_salted_chunks_and_shards_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "CHUNK", 3)
    monkeypatch.setattr(duplicates, "SHARD", 5)
    rows = catalogue(3, 80)
    got = duplicates.cluster(spark.createDataFrame(rows, FIELDS), 0.8, 16).collect()
    assert {r["row_idx"]: r["centre"] for r in got} == greedy(rows, 0.8)


def test_group_of_two_spellings(spark):
    rows = [(0, "ABB Industrial Motor M3BP 160", "ABB", "", "ABB-MTR-160"),
            (1, "abb m3bp 160 motor 15kw", "ABB", "", "ABB MTR 160")]
    df = spark.createDataFrame(rows, FIELDS)
    for c in ("product_id", "power", "voltage", "source"):
        df = df.withColumn(c, F.lit("x"))
    df = df.withColumn("price", F.lit(1.5))
    items = duplicates.duplicate_items(df, duplicates.cluster(df, 0.75))
    group = duplicates.duplicate_groups(items).first()
    assert (group["group_code"], group["members"], group["similarity"]) == ("DUP-0001", 2, 0.95)
    assert "Price: 1.5" in items.first()["specs_summary"]


def test_number_rows(spark):
    df = spark.range(0, 100, 3).repartition(3)
    got = number_rows(df, "id", "n", start=1, width=8).orderBy("id").collect()
    assert [r["n"] for r in got] == list(range(1, len(got) + 1))


def test_pairs_are_sieved_before_python(spark):
    rows = catalogue(5, 150)
    member = duplicates._open_nodes(duplicates.with_keys(spark.createDataFrame(rows, FIELDS)))[0]
    pairs = duplicates._side(member, "a", "block").join(duplicates._side(member, "b", "block"), "block").where(
        "a_node < b_node")
    near = duplicates.reaching(pairs, 0.8)
    plan = near._jdf.queryExecution().executedPlan().toString()
    join, python = plan.index("Join"), plan.index("ArrowEvalPython")
    assert python < join and "bit_count" in plan[join:] and "bit_count" not in plan[:join]
    asked, left = pairs.count(), pairs.where(duplicates.possible(0.8)).count()
    scored = pairs.where(duplicates.possible(0.8)).where(duplicates._rule().isNull()).count()
    want = sum(similarity(a, b) >= 0.8 for i, a in enumerate(rows) for b in rows[i + 1:] if blocks(a) & blocks(b))
    found = near.select("a_node", "b_node").distinct().count()
    assert found <= want and 0 < scored < left < 0.7 * asked


def test_low_nodes_hold_the_first_of_each_block(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "RANKED", 10)
    live = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("node"), (F.col("id") % 3 * (F.col("id") % 2)).alias("block"))
    for batch in (20, 300, 4000):
        low = duplicates._low_nodes(live, batch)
        for block, in live.select("block").distinct().collect():
            every = sorted(r["node"] for r in live.where(F.col("block") == block).collect())
            kept = sorted(r["node"] for r in low.where(F.col("block") == block).collect())
            assert kept[:batch] == every[:batch]
            assert len(kept) <= max(3 * batch, 50) or len(every) < 3 * batch
