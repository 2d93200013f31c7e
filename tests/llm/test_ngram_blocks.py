"""Blocks of the n-gram join: roots within a block, few edges between blocks."""

import numpy as np
import pytest

from tests.llm.test_ngram_join import all_pairs, frame
from tidyshelf.llm import ngram_join as nj


def labels(n, edges):
    out = list(range(n))
    for a, b in edges:
        out = [out[b] if x == out[a] else x for x in out]
    return out


def same(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("share", [0.0, 0.02, 0.1, 0.6])
def test_roots_and_root_edges_connect_what_links_connect(share):
    rnd = np.random.default_rng(int(share * 100))
    links = rnd.random((40, 40)) < share
    links |= links.T
    np.fill_diagonal(links, False)
    left, right, cross = links[:25, :25], links[25:, 25:], links[:25, 25:]
    own, other = nj.roots(left), nj.roots(right)
    edges = [(i, int(r)) for i, r in enumerate(own)] + [(25 + j, 25 + int(r)) for j, r in enumerate(other)]
    between = nj.root_edges(cross, own, other)
    assert len(between) < len(set(own)) + len(set(other))
    edges += [(i, 25 + j) for i, j in between]
    assert same(labels(40, edges), labels(40, list(zip(*np.nonzero(links)))))


def test_edges_of_near_copies_grow_with_their_number(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 8)     # deals the members of a relation over all tasks
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[:399] + [f"end{k}"])) for k in range(90)]
    docs = frame(spark, rows)
    profiled = nj.profile(docs)
    classes = nj.classes_of(profiled)
    entries = nj.shared_entries(docs, nj.bucket_ranks(profiled))
    pairs = nj.sieved(nj.related_pairs(entries, classes), classes, profiled)
    blocks = nj.member_blocks(docs, classes, pairs)
    assert blocks.count() > 2
    found = nj.answers(blocks, pairs)
    assert found.where("other IS NOT NULL AND other <> cid").count() < 2 * len(rows)
    assert sorted((tuple(r) for r in nj.jaccard_join(docs).collect()), key=str) == all_pairs(rows)


def test_packed_sets_come_back_and_near_copies_take_few_bytes():
    rng = np.random.default_rng(5)
    drawn = lambda n: np.unique(rng.integers(0, 1 << 63, n, np.uint64))
    base = drawn(400)
    near = [base] + [np.unique(np.concatenate([rng.choice(base, 380, False), drawn(20)])) for _ in range(60)]
    far = [drawn(n) for n in (1, 300, 7, 500)]
    for sets in (near, far, near + far, near[:1], far[:1], [drawn(70_000), drawn(9)], [base, base[:1]]):
        grams, counts, places = nj.pack_sets(sets)
        back = nj.unpack_sets(len(sets[0]), grams, counts, places)
        assert len(back) == len(sets) and all(np.array_equal(a, b) for a, b in zip(back, sets))
    assert 8 * sum(map(len, near)) > 10 * sum(map(len, nj.pack_sets(near)))


def test_the_larger_block_stays_and_is_repeated_for_many_partners(spark):
    blocks = spark.createDataFrame(
        [(0, 7, b"x" * 900, b"x" * 100)] + [(i, 100 + i, b"x" * (8 + i % 3), b"") for i in range(1, 201)],
        "block long, leader long, grams binary, places binary")
    pairs = spark.createDataFrame([(7, 100 + i) for i in range(1, 101)] + [(100 + i, 7) for i in range(101, 201)],
                                  "a long, b long")
    tiles, parts = nj.block_pairs(blocks, pairs)
    rows = tiles.collect()
    assert {(r.x, r.y) for r in rows} == {(i, 0) for i in range(1, 201)} and len(rows) == 200
    assert [tuple(r) for r in parts.collect()] == [(0, 4)]
    assert {r.part for r in rows} == set(range(4))
