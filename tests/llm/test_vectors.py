"""Hard negatives and whitening against plain numpy, and their defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyshelf.llm import hard_negatives as hn
from tidyshelf.llm import whitening
from tidyshelf.llm.frames import table
from tidyshelf.llm.queries import op11_hard_negatives, op13_whitening

FOLDER = "/root/testdata/sf0.1"
NAN, INF = float("nan"), float("inf")
ROW = "vec_id long, embedding array<double>, label long, score string, anchor string, n string, block string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, "?", "?", "?", "?") for i, v, k in rows], ROW)


def plain_negatives(ids, labels, x):
    """The contract, row by row; ids may repeat or be None."""
    order = [10 ** 18 if i is None else i for i in ids]
    y = np.floor(256 * x).astype(np.int64)
    out = []
    for i in range(len(ids)):
        if ids[i] is None or ids[i] % 100:
            continue
        s = (y @ y[i]).tolist()
        ranked = sorted((k for k in range(len(ids)) if k != i), key=lambda k: (-s[k], order[k]))
        for k in [k for k in ranked if labels[k] == labels[i]][:5]:
            fit = [m for m in ranked if labels[m] != labels[i] and 80 * s[k] <= 100 * s[m] <= 100 * s[k]][:5]
            out += [(ids[i], ids[k], r, ids[m], s[k], s[m]) for r, m in enumerate(fit, 1)]
    return sorted(out, key=str)


def mined(rows):
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
                   for r in rows.collect()), key=str)


def test_hard_negatives_of_the_table(spark):
    rows = table(spark, FOLDER, "embeddings").toPandas()
    ids = rows.vec_id.tolist()
    labels = [(k + 1) % 10 if i % 7 == 0 else k for i, k in zip(ids, rows.label)]
    want = plain_negatives(ids, labels, np.array(rows.embedding.tolist(), float))
    assert mined(op11_hard_negatives(spark, FOLDER)) == want


def test_hard_negatives_skip_blocks_of_clustered_vectors(spark):
    random = np.random.default_rng(3)
    centres = random.normal(size=(5, 16)) * 3
    x = centres[random.integers(0, 5, 20_000)] + random.normal(size=(20_000, 16)) * 0.05
    labels = (np.abs(x[:, 0] * 97).astype(int) % 3).tolist()
    df = vectors(spark, [(i, v, k) for i, (v, k) in enumerate(zip(x.tolist(), labels))])
    got = mined(hn.hard_negatives(df, F.col("vec_id") % 100 == 0, F.col("label")))
    assert got == plain_negatives(list(range(len(x))), labels, x)
    rows, width = hn.usable(df.select("vec_id", "label", (F.col("vec_id") % 100 == 0).alias("anchor"),
                                      F.col("embedding").alias("v")), "v", 2.0 ** 22)
    blocks = hn.blocks_of(rows, width)
    anchors = hn.anchors_of(blocks, width)
    groups = hn._groups(anchors.withColumn("windows", F.lit(np.full(5, -1, np.int64).tobytes())))
    asked = hn._requests(groups, hn._zone_chunks(blocks), width, same_label=True)
    read = sum(np.frombuffer(r["wanted"], bool).sum() for r in asked.collect())
    assert read < 0.6 * blocks.count() / 3 * anchors.count()


def test_hilbert_neighbours_differ_in_one_step():
    side = 8
    cells = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hn.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(side ** 3))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_hard_negatives_defined_cases(spark):
    random = np.random.default_rng(5)
    x = np.round(random.normal(size=(60, 4)), 1)           # many ties
    rows = [(i * 10 % 250, v, int(k)) for i, (v, k) in enumerate(zip(x.tolist(), random.integers(0, 2, 60)))]
    rows += [rows[0], (None, x[1].tolist(), 1), (None, x[2].tolist(), 0)]
    bad = [(100, None, 1), (100, [1.0, None, 0.0, 0.0], 1), (100, [NAN, 0.0, 0.0, 0.0], 0), (100, [INF, 0.0, 0.0, 0.0], 0),
           (100, [1.0, 1.0, 1.0, 1.0], None), (100, [1.0], 1), (100, [], 1), (200, [1e30, 0.0, 0.0, 0.0], 1)]
    got = mined(hn.hard_negatives(vectors(spark, rows + bad), F.col("vec_id") % 100 == 0, F.col("label")))
    want = plain_negatives([r[0] for r in rows], [r[2] for r in rows], np.array([r[1] for r in rows]))
    # Of rows equal in id and score any may stand first; they cannot be told apart in the result.
    assert got == want and got
    assert mined(hn.hard_negatives(vectors(spark, []), F.col("vec_id") % 100 == 0, F.col("label"))) == []
    alone = vectors(spark, [(0, [1.0, 2.0], 1)])
    assert mined(hn.hard_negatives(alone, F.col("vec_id") % 100 == 0, F.col("label"))) == []


def whitened(df, count, n):
    rows = df.orderBy("vec_id", "component").collect()
    assert len(rows) == count * n
    return rows, np.array([r["whitened"] for r in rows]).reshape(n, count)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", FOLDER])
def test_whitening_of_the_table(spark, folder):
    source = table(spark, folder, "embeddings").orderBy("vec_id").toPandas()
    x = np.floor(64 * np.array(source.embedding.tolist(), float)) + 1_000_000
    n = len(x)
    rows, white = whitened(op13_whitening(spark, folder), 32, n)
    centred = x - x.mean(axis=0)
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1][:32], turn[:, ::-1][:, :32]
    want = centred @ turn / np.sqrt(values)
    want *= np.sign((want * white).sum(axis=0))
    assert np.abs(white - want).max() < 1e-8
    assert [r["component"] for r in rows[:32]] == list(range(1, 33))
    assert np.allclose([r["explained"] for r in rows[:32]], values / np.trace(centred.T @ centred / n), rtol=1e-9)
    assert {r["n"] for r in rows} == {n} and {r["identity_error"] for r in rows}.pop() < 1e-10
    whole = x.astype(np.int64)
    deviation = ((n * whole - whole.sum(axis=0)) ** 2).sum(axis=1)
    assert [r["deviation"] for r in rows[::32]] == deviation.tolist()


def test_subspace_iterates_on_wide_covariances():
    """Slowly falling spectra of more dimensions than the block holds, against the full decomposition."""
    random = np.random.default_rng(11)
    for values in (1 / np.arange(1, 301), np.linspace(2, 1, 300), np.r_[np.full(5, 4.0), np.full(295, 0.5)]):
        q = np.linalg.qr(random.normal(size=(300, 300)))[0]
        inner = (q * values) @ q.T

        class Plain:
            width, passes = 300, 0

            def __matmul__(self, block):
                self.passes += 1
                return inner @ block

        v = Plain()
        found, got, worst = whitening.subspace(v, 5)
        assert np.allclose(got, values[:5], rtol=1e-11) and worst < 1e-11
        assert np.abs(found @ found.T - q[:, :5] @ q[:, :5].T).max() < 1e-8
        assert 1 < v.passes < 400


def test_whitening_defined_cases(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0)])).collect() == []
    assert whitening.whiten(vectors(spark, [(i, [1.0, 2.0], 0) for i in range(5)])).collect() == []
    rows = [(1, [0.0, 0.0, 5.0], 0), (1, [0.0, 0.0, 5.0], 0), (None, [4.0, 0.0, 5.0], 0), (2, [1.0, 1.0, 5.0], None)]
    bad = [(7, None, 0), (8, [1.0, None, 0.0], 0), (9, [NAN, 0.0, 0.0], 0), (9, [INF, 0.0, 0.0], 0), (9, [1.0], 0),
           (9, [1e30, 1.0, 1.0], 0)]
    got = whitening.whiten(vectors(spark, rows + bad)).collect()
    assert sorted({r["component"] for r in got}) == [1, 2] and len(got) == 8   # the third dimension never varies
    assert {r["n"] for r in got} == {4} and sum(r["vec_id"] is None for r in got) == 2
    assert got[0]["identity_error"] < 1e-12
    large = whitening.whiten(vectors(spark, [(i, [2.0 ** 40 * i, 1.0], 0) for i in range(4)])).collect()
    assert len(large) == 4 and large[0]["deviation"] is None
