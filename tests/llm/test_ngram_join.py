"""The n-gram Jaccard join against all pairs, and its parts against plain restatements."""

import random
import re

import numpy as np
import pytest

from tidyshelf.llm import ngram_join as nj
from tidyshelf.llm.frames import table

ROW = "doc_id long, text string, cid string, n string, leader string, grams string, links string"


def grams_of(text, width=5):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def all_pairs(rows, least=80):
    """(doc_id, size, component, links) by comparing sets that share an n-gram."""
    sets = [grams_of(t) for _, t in rows]
    lists, counts = {}, {}
    for k, s in enumerate(sets):
        for g in s:
            lists.setdefault(g, []).append(k)
    for own in lists.values():
        for i, a in enumerate(own):
            for b in own[i + 1:]:
                counts[a, b] = counts.get((a, b), 0) + 1
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), both in counts.items():
        if 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    first = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            first[root(k)] = min(first.get(root(k), i), i)
    return sorted(((i, len(sets[k]), first.get(root(k)), links[k]) for k, (i, _) in enumerate(rows)), key=str)


def joined(df, **more):
    return sorted((tuple(r) for r in nj.jaccard_join(df, **more).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *"?????") for i, t in rows], ROW)


def test_the_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert joined(docs) == all_pairs([tuple(r) for r in docs.select("doc_id", "text").collect()])


def near_copies(seed, groups, copies, words=150):
    """Groups of texts that differ from a common one in a few words, so that links lie around the threshold."""
    rnd = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(len(own))] = f"x{rnd.randint(0, 3)}"
            if rnd.random() < 0.2:
                own += base[:rnd.randint(1, 30)]
            rows.append((len(rows), " ".join(own)))
    return rows


def test_large_groups_of_near_copies(spark):
    rows = near_copies(1, 3, 220) + near_copies(2, 30, 3)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    want = all_pairs(rows)
    assert joined(frame(spark, rows)) == want
    assert len({r[2] for r in want}) > 10 and any(r[3] > 100 for r in want)


def test_defined_cases(spark):
    long = " ".join(f"word{i % 9973}x{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t\x0b "), (4, "one two three"), (5, "ONE  two\nthree"), (6, "one two four"),
            (None, "no id here but words enough for a gram"), (None, "no id here but words enough for a gram"),
            (7, "no id here but words enough for a gram"), (None, "alone without id and copies at all"),
            (8, long), (9, long + " end"), (9, "same id other text"), (9, "same id other text"),
            (10, "Ünïcödé ☃ 😀 words of many kinds"), (11, "x" * 100_000)]
    assert joined(frame(spark, rows)) == all_pairs(rows)
    assert joined(frame(spark, [])) == []


def random_sets(rnd, count):
    base = rnd.integers(0, 1 << 62, 80).astype(np.uint64)
    out = []
    for _ in range(count):
        own = base[rnd.random(80) < 0.9]
        out.append(np.unique(np.concatenate([own, rnd.integers(0, 40, rnd.integers(0, 12)).astype(np.uint64)])))
    return out


def test_derived_overlaps_equal_intersections(monkeypatch):
    monkeypatch.setattr(nj, "COLUMNS_AT_ONCE", 7)
    rnd = np.random.default_rng(2)
    left, right = random_sets(rnd, 9), random_sets(rnd, 13)
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]
    assert nj.overlaps(left, right).tolist() == want
    assert nj.overlaps(left, left)[0, 0] == len(left[0])


def test_sketches_bound_intersections_from_above():
    rnd = np.random.default_rng(8)
    mixed = lambda s: nj._mixed(s * np.uint64(3) + np.uint64(1))
    close = 0
    for size in (1, 3, 40, 400, 3000):
        base = np.arange(size, dtype=np.uint64)
        for changed in (0, size // 10, size):
            other = np.unique(np.concatenate([base[changed:], rnd.integers(1 << 40, 1 << 41, changed + size // 5).astype(np.uint64)]))
            a, b = mixed(base), mixed(other)
            both = len(set(a.tolist()) & set(b.tolist()))
            most = nj.most_shared(len(a), nj.sketch(a), len(b), nj.sketch(b))
            assert both <= most
            close += most <= both + 0.3 * size
    assert close >= 10


@pytest.mark.parametrize("share", [0.02, 0.1, 0.5])
def test_forest_connects_what_links_connect(share):
    links = np.random.default_rng(4).random((30, 40)) < share
    edges = nj.forest(links)
    assert all(links[i, j] for i, j in edges)

    def parts(pairs):
        parent = list(range(70))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for i, j in pairs:
            parent[root(i)] = root(30 + j)
        return [root(x) for x in range(70)]

    same = lambda p: [[a == b for b in p] for a in p]
    assert same(parts(edges)) == same(parts(zip(*map(np.ndarray.tolist, np.nonzero(links)))))
    assert len(edges) == 70 - len(set(parts(edges)))


def test_long_lists_lose_no_pair_by_skipping(monkeypatch):
    monkeypatch.setattr(nj, "LIST_BLOCK", 8)
    rnd = np.random.default_rng(9)
    small = rnd.integers(10, 200, 150)
    large = small + rnd.integers(0, 5, 150)
    rest = np.sort(np.minimum(small, rnd.integers(1, 200, 150)))[::-1]
    got = set(zip(*map(np.ndarray.tolist, nj.list_pairs(np.arange(150), small, large, rest))))
    want = {(i, j) for i in range(150) for j in range(i + 1, 150)
            if nj._may_link(small[i], large[i], rest[i], small[j], large[j], rest[j], 80)}
    assert got == want and 0 < len(want) < 150 * 149 / 4


def test_prefixes_of_linked_sets_meet():
    for a in range(1, 60):
        for b in range(a, 60):
            for both in range(a + 1):
                if 100 * both >= 80 * (a + b - both):
                    assert both >= a - nj.prefix_length(a) + 1 and both >= b - nj.prefix_length(b) + 1
