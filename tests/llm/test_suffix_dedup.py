import random
from collections import Counter

import numpy as np
import pytest

from querent.llm.suffix_dedup import Family, Level, remove_repeats, repeated_passages, sliding_argmin


def brute(rows, length):
    texts = {i: (t or "").encode() for i, t in rows}
    seen = Counter(t[i : i + length] for t in texts.values() for i in range(len(t) - length + 1))
    out = {}
    for d, t in texts.items():
        cover = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        edge = np.diff(gone.astype(int), prepend=0, append=0)
        out[d] = (len(t), list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())), bytes(np.frombuffer(t, np.uint8)[~gone]))
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in df.collect()}


@pytest.mark.parametrize(("length", "gram", "hot", "batch"), [(400, 100, 4096, 2048), (60, 16, 4096, 7), (60, 16, 1, 7)])
def test_equals_brute_force(spark, docs, rows, length, gram, hot, batch):
    """A hot limit of 1 deals every contested anchor window by window."""
    assert got(remove_repeats(docs, length, gram, batch_size=batch, hot=hot, most=20)) == brute(rows, length)


def test_short_repeats_at_every_offset(spark):
    """Strings of exactly the length, amid bytes that differ, at all alignments."""
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    core = letters(40)
    rows = [(i, letters(i) + core[: 39 + i % 3] + letters(50 - i)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(remove_repeats(df, 40, 12, batch_size=5)) == brute(rows, 40)


def test_odd_tables(spark, empty):
    assert got(remove_repeats(empty)) == {}
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert got(remove_repeats(df)) == {1: (0, [], b""), 2: (0, [], b"")}


def test_null_ids_shared_ids_and_repeated_rows(spark):
    """Rows are documents: one that repeats as a whole loses all in both rows; texts of one id, or of none, are told apart."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    core, twin, other = letters(60), letters(90), letters(70)
    rows = [(None, "x" + core), (None, "y" + core + "z"), (7, core), (7, other), (8, twin), (8, twin), (9, "h" * 20)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, a int, row string")
    out = sorted((r.doc_id or 0, r.n_bytes, bytes(r.kept)) for r in remove_repeats(df, 40, 12).collect())
    assert out == sorted([(0, 61, b"x"), (0, 62, b"yz"), (7, 60, b""), (7, 70, other.encode()), (8, 90, b""), (8, 90, b""), (9, 20, b"h" * 20)])


def brute_words(rows, n):
    words = [(t or "").lower().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = {}
    for (d, _), w in zip(rows, words, strict=True):
        hit = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        if hit:
            out[d] = len(hit)
    return out


@pytest.mark.parametrize(("words", "gram"), [(51, 13), (12, 4)])
def test_passages_equal_brute_force(spark, docs, rows, words, gram):
    out = {r.doc_id: r.n_words for r in repeated_passages(docs, words, gram).collect()}
    assert out == brute_words(rows, words) and len(out) > 10


def test_sliding_argmin():
    v = np.random.default_rng(1).integers(0, 9, 500).astype(np.uint64)
    for w in (1, 2, 3, 7, 64):
        assert sliding_argmin(v, w).tolist() == [i + int(np.argmin(v[i : i + w])) for i in range(500 - w + 1)]


def test_levels_double():
    family = Family(8, 1)
    for i in range(11):
        family.add(Level([i], [b""], [b"x" * 8], np.array([0]), np.array([0]), [b"t"], np.zeros((1, 5), bool)))
    assert [len(x) for x in family.levels] == [8, 2, 1]
    assert not any(x.found.any() for x in family.levels)
    family.add(Level([3], [b""], [b"x" * 8], np.array([0]), np.array([0]), [b"u"], np.zeros((1, 5), bool)))
    assert sum(int(x.found[:, 0].sum()) for x in family.levels) == 2
