"""Runs of jobs and incremental clusters against plain restatements."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_duplicates import FIELDS, catalogue, greedy
from tidyshelf.operators import duplicates
from tidyshelf.sources.generate import COLUMNS, generate_catalog
from tidyshelf.streaming import clusters, feed, runs

ENDS = ["done", "failed"]
WAIT = 100


def plain(events, upto):
    """(job, started, updated, count, processed, ended_by, status) with times in seconds."""
    out, by_job = [], {}
    for e in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        by_job.setdefault(e[0], []).append(e)
    for job, rows in by_job.items():
        pieces = []
        for e in rows:
            if e[1] >= upto:
                continue
            if not pieces or pieces[-1][-1][4] in ENDS or e[1] - pieces[-1][-1][1] > WAIT:
                pieces.append([])
            pieces[-1].append(e)
        for p in pieces:
            end = p[-1][4] if p[-1][4] in ENDS else None
            status = "finished" if end else "stalled" if p[-1][1] + WAIT < upto else "open"
            out.append((job, p[0][1], p[-1][1], len(p), max(e[3] for e in p), end, status))
    return sorted(out, key=str)


def as_rows(df):
    return sorted(((r["job_id"], int(r["s"]), int(r["u"]), r["event_count"], r["processed"], r["ended_by"], r["status"])
                   for r in df.withColumn("s", F.unix_seconds("started")).withColumn(
                       "u", F.unix_seconds("updated")).collect()), key=str)


def some_events(seed, n):
    rnd = random.Random(seed)
    # a third of the events are of one job; some times are equal
    return [(rnd.choice(["hot", f"j{rnd.randint(0, 9)}", f"j{rnd.randint(0, 9)}"]), rnd.randint(1, 3000), i,
             rnd.randint(0, 99), rnd.choice(["tick"] * 6 + ENDS)) for i in range(n)]


SCHEMA = "job_id string, sec long, event_id long, processed long, event string"


def frame(spark, events):
    return spark.createDataFrame(events, SCHEMA).withColumn("ts", F.timestamp_seconds("sec")).drop("sec")


@pytest.mark.parametrize("width", [50, 86_400])
def test_runs_of_a_table(spark, width):
    events = some_events(1, 400)
    got = runs.runs(frame(spark, events), terminal=ENDS, patience=WAIT, upto=F.lit(2500 * 1_000_000), width=width)
    assert as_rows(got) == plain(events, 2500)
    last = max(e[1] for e in events)
    assert as_rows(runs.runs(frame(spark, events), terminal=ENDS, patience=WAIT, width=width).where(
        "status <> 'open'")) == [r for r in plain(events, last + 1) if r[6] != "open" and not (
            r[6] == "stalled" and r[2] + WAIT >= last)]
    nobody = spark.createDataFrame([(None, 5, 1, 1, "tick"), ("a", None, 2, 1, "tick")], SCHEMA)
    assert runs.runs(nobody.withColumn("ts", F.timestamp_seconds("sec"))).count() == 0


def test_watch_equals_the_table(spark, tmp_path):
    events, late = some_events(2, 500), 60
    rnd = random.Random(3)
    # events come up to 50 seconds out of order, and some far too late, which a stream leaves out
    order = sorted(events, key=lambda e: e[1] + rnd.randint(0, 50))
    cuts = [order[:150], order[150:350], order[350:] + [("j1", 3, 9_999, 1, "done")]]
    for k, part in enumerate(cuts):
        frame(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    schema = frame(spark, events).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    found = runs.watch(stream, f"{late} seconds", terminal=ENDS, patience=WAIT)
    for _ in range(2):   # a second start finds nothing new
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(200)
    upto = max(e[1] for e in events) - late
    got = as_rows(spark.read.schema(found.schema).parquet(str(tmp_path / "out")))
    assert got == [r for r in plain(events, upto) if r[6] != "open"]
    assert {r[6] for r in got} == {"finished", "stalled"}


def test_sessions(spark):
    times = [("a", 0), ("a", 50), ("a", 149), ("a", 400), ("b", 20)]
    df = spark.createDataFrame(times, "k string, sec long").withColumn("ts", F.timestamp_seconds("sec"))
    got = runs.sessions(df, "k", gap="100 seconds").select(
        "k", F.unix_seconds("session_start"), F.unix_seconds("session_end"), "event_count").collect()
    assert sorted(map(tuple, got)) == [("a", 0, 249, 3), ("a", 400, 500, 1), ("b", 20, 120, 1)]


@pytest.mark.parametrize("seed,cuts,shard", [(5, [0, 40, 41, 90], 4096), (6, [0, 60, 120], 3)])
def test_batches_equal_one_run(spark, tmp_path, monkeypatch, seed, cuts, shard):
    monkeypatch.setattr(clusters, "SHARD", shard)
    rows, state = catalogue(seed, cuts[-1]), str(tmp_path / "state")
    # a name without letters, twice
    rows += [(len(rows), "!!!", "Zed", "Pumps", ""), (len(rows) + 1, "!!!", "Zed", "Pumps", "")]
    edges = [*cuts, len(rows) - 1, len(rows)]
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        if a == b:
            continue
        batch = spark.createDataFrame(rows[a:b], FIELDS)
        clusters.add_batch(batch, state, k)
    clusters.add_batch(batch, state, k)   # a replay of the last batch
    got = {r["row_idx"]: r["centre"] for r in clusters.clusters(spark, state).collect()}
    assert got == greedy(rows, 0.8) | {len(rows) - 2: len(rows) - 2, len(rows) - 1: len(rows) - 2}
    one = duplicates.cluster(spark.createDataFrame(rows, FIELDS)).collect()
    assert got == {r["row_idx"]: r["centre"] for r in one}
    changed = {r["row_idx"] for r in clusters.touched(spark, state, 1).collect()}
    fresh = set(range(edges[1], edges[2]))
    heads = {got[i] for i in fresh if i in got}
    seen = [i for i in got if i < edges[2] and got[i] in heads]
    assert changed == {i for i in seen if sum(got[j] == got[i] for j in seen) > 1}


def test_feed_with_clusters(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")
    rows = generate_catalog(spark, 40).select(COLUMNS)
    for k in range(2):   # the second file repeats the first
        rows.coalesce(1).write.option("header", True).csv(str(source / str(k)))
    raw = feed.read_feed(spark, str(source / "*"), COLUMNS, maxFilesPerTrigger=1)
    feed.start_feed(raw, str(tmp_path / "out"), str(tmp_path / "check"), state=state).awaitTermination(300)
    landed = spark.read.parquet(str(tmp_path / "out"))
    assert landed.select("batch_id").distinct().count() == 2
    found = {r["row_idx"]: r["centre"] for r in clusters.clusters(spark, state).collect()}
    assert found == {r["row_idx"]: r["centre"] for r in duplicates.cluster(landed).collect()}
    assert len(found) == 80
