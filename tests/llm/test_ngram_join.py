import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from querent.llm import ngram_join
from querent.llm.common import components
from querent.llm.ngram_join import keep_representatives, ngram_components
from querent.llm.rtree import CountTree

from .conftest import corpus


def shingles(text, k):
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            n = len(sets[i] & sets[j])
            if sets[i] and den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize(("k", "num", "block"), [(3, 90, 2048), (5, 80, 2048), (3, 90, 3)])
def test_components_equal_brute_force(spark, docs, rows, k, num, block):
    """Blocks of 3 points cut every shard, so the second search has to find what crosses them."""
    assert got(ngram_components(docs, k=k, num=num, block=block)) == brute(rows, k, num, 100)


def test_other_seeds(spark):
    rows = corpus(seed=9, n=25)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_components(df, k=3, num=85)) == brute(rows, 3, 85, 100)


def test_repeated_and_null_rows(spark, empty):
    assert got(ngram_components(empty)) == {}
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert got(ngram_components(df, k=3, num=90)) == {1: (4, 1), 2: (4, 1)}
    kept = keep_representatives(df)
    assert Counter(r.doc_id for r in kept.collect()) == {1: 1, None: 1}


def test_every_pair_that_links_shares_a_shard():
    rng = np.random.default_rng(3)
    for n in (10, 17, 40, 200, 999):
        for num in (80, 90):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            for _ in range(20):
                d = int((1 - num / 100) / (1 + num / 100) * len(a))
                b = np.unique(np.concatenate([rng.permutation(a)[d:], rng.integers(0, 2**64, rng.integers(0, d + 1), dtype=np.uint64)]))
                inter = len(np.intersect1d(a, b))
                if 100 * inter >= num * (len(a) + len(b) - inter) and not np.array_equal(a, b):
                    assert set(ngram_join.shard_keys(a, num, 100).tolist()) & set(ngram_join.shard_keys(b, num, 100).tolist())


def test_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 6, (300, 16))
    points[1::3] = points[::3]
    sizes = points.sum(axis=1)
    tree = CountTree(points, sizes, 80, 100)
    for i in range(300):
        bound = np.minimum(points, points[i]).sum(axis=1)
        want = set(np.flatnonzero(180 * bound >= 80 * (sizes + sizes[i])).tolist())
        assert set(tree.search(i)[0].tolist()) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 3), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = defaultdict(int) | {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert got == dict(want)
