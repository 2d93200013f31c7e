"""The numpy kernel against a plain dynamic programme."""

from collections import Counter

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidyshelf.functions import indel, similarity


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], (diagonal + 1 if x == y else max(row[j], row[j - 1]))
    return row[-1]


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial(a, b):
    def best(short, long):
        n, m = len(short), len(long)
        windows = [long[max(0, e - n):min(e, m)] for e in range(1, m + n)]
        return max(ratio(short, w) for w in windows)
    if not a or not b:
        return 1.0 if a == b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    return max(best(short, long), best(long, short)) if len(a) == len(b) else best(short, long)


words = st.text(alphabet="abcd é", max_size=90)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=6))
def test_indel_ratio(pairs):
    left, right = [p[0] for p in pairs], [p[1] for p in pairs]
    want = [ratio(a, b) for a, b in pairs]
    assert np.allclose(indel.indel_ratios(left, right), want)
    assert indel.lcs_lengths(left, right, slice_rows=2).tolist() == [lcs(a, b) for a, b in pairs]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=4))
def test_partial_ratio(pairs):
    left, right = [p[0] for p in pairs], [p[1] for p in pairs]
    want = [partial(a, b) for a, b in pairs]
    assert np.allclose(indel.partial_ratios(left, right), want)
    assert np.allclose(indel.partial_ratios(left, right, slice_rows=7), want)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=5))
def test_partial_bounds(pairs):
    left, right = [p[0] for p in pairs], [p[1] for p in pairs]
    least, most = indel.partial_bounds(left, right)
    for (a, b), low, high in zip(pairs, least, most):
        if a and b:
            assert low - 1e-9 <= partial(a, b) <= high + 1e-9


def names(seed, n):
    rnd = np.random.default_rng(seed)
    vocabulary = ["motor", "pump", "valve", "heavy", "duty", "m3bp-160", "steel", "mini", "servo", "15", "kw", "kw", "ünit"]
    return [" ".join(rnd.choice(vocabulary, rnd.integers(1, 6))) for _ in range(n)]


def sorted_name(name):
    return " ".join(sorted(name.split()))


def test_reach_agrees_with_the_score():
    a, b = names(1, 600), names(2, 600)
    pairs = pd.DataFrame({"ta": list(map(sorted_name, a)), "tb": list(map(sorted_name, b)), "na": a, "nb": b,
                          "boosted": [i % 2 == 0 for i in range(600)]})
    scores = indel.name_similarities(pairs)
    for floor in (0.5, 0.8, 0.95):
        assert indel.names_reach(pairs, floor).tolist() == (scores >= floor).tolist()
    assert 5 < (scores >= 0.8).sum() < 580


def test_long_names_take_bounded_memory():
    import tracemalloc

    rnd = np.random.default_rng(3)
    a = "".join(rnd.choice(list("abcdefghij "), 10_000))
    b = a[:6000] + "".join(rnd.choice(list("klmnop"), 4000))
    left, right = [a, *names(4, 3000)], [b, *names(5, 3000)]
    tracemalloc.start()
    found = indel.lcs_lengths(left, right, slice_rows=4096)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0] >= 6000 and peak < 200 << 20
    assert found[1:50].tolist() == [lcs(x, y) for x, y in zip(left[1:50], right[1:50])]


def test_shared_characters_bound_the_subsequence(spark):
    a, b = names(6, 400) + ["zzzzzz" * 9, "é" * 70, "", "9" * 40], names(7, 400) + ["zzzzz aaaa" * 8, "é" * 30 + "ü", "x", "99-99"]
    rows = spark.createDataFrame(list(zip(a, b)), "a string, b string")
    bits = lambda c: similarity.letter_bits(F.col(c))
    most = similarity.most_common_letters(F.length("a"), bits("a"), F.length("b"), bits("b"))
    got = rows.select("a", "b", most.alias("most")).collect()
    assert all(lcs(r["a"], r["b"]) <= r["most"] <= min(len(r["a"]), len(r["b"])) for r in got)
    exact = sum(r["most"] == sum((Counter(r["a"]) & Counter(r["b"])).values()) for r in got)
    assert exact > 300
