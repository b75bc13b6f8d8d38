import math
import random
from functools import partial

import numpy as np
import pytest

from querent.llm import hard_negatives as H

DDL = "vec_id long, embedding array<double>, label long, row string, cell int"


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90):
    whole = set()
    for vec_id, x, label in rows:
        if None not in (vec_id, x, label) and all(v is not None and math.isfinite(v) for v in x):
            whole.add((vec_id, label, tuple(math.floor(256 * v) for v in x)))
    out = []
    clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    for a in (r for r in whole if r[0] % every == 0):
        scored = sorted((-clip(sum(p * q for p, q in zip(a[2], r[2]))), r[0], r[1]) for r in whole if r != a)
        for s, pid, _ in [r for r in scored if r[2] == a[1]][:positives]:
            fit = [r for r in scored if r[2] != a[1] and low * -s <= 100 * -r[0] <= high * -s]
            out += [(a[0], pid, k, r[1], -s, -r[0]) for k, r in enumerate(fit[:negatives], 1)]
    return sorted(out)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], DDL).repartition(3)
    return sorted(map(tuple, H.mine(df, **kw).collect()))


def vectors(n, dims, seed, labels=3, lumps=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(lumps, 1), dims)) * 4
    return [(i, (rng.normal(size=dims) * 0.3 + (centres[i % lumps] if lumps else 0)).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize(("pivots", "block"), [(1, 4096), (12, 4096), (12, 3), (500, 7)])
@pytest.mark.parametrize("lumps", [0, 6])
def test_equals_brute_force(spark, pivots, block, lumps):
    """One cell, cells packed into one group, groups of a few anchors, and a pivot for every row."""
    rows = vectors(240, 5, 3, lumps=lumps)
    assert got(spark, rows, every=10, pivots=pivots, block=block) == brute(rows, every=10) != []


def test_rows_go_only_where_they_might_serve(spark):
    """Lumps far apart: most pairs of rows and groups are never made, and none that serves is missing."""
    rows = vectors(600, 4, 5, lumps=10)
    df = spark.createDataFrame([(*r, "", 1) for r in rows], DDL)
    table = H.whole(df).cache()
    norm = max(math.sqrt(sum(v * v for v in r.vector)) for r in table.collect())
    cells = H.Cells(table, table.filter("vec_id % 10 = 0").select("vec_id", "label", "row", "vector"), 4, norm, 20, 4, 16)
    far = cells.within(6)
    slack = norm * 1e-6
    needed = partial(H._needed, pivots=cells.pivots, most=norm, inner=np.full(len(far), -np.inf), outer=far + cells.reach + slack, group=cells.group)
    sent = table.select("vec_id", "label", "row", "vector").mapInArrow(needed, H._ROWS_DDL + ", group long").count()
    assert sent < 0.7 * 600 * (cells.group.max() + 1)


def test_ties_copies_and_repeated_rows(spark):
    rng = random.Random(2)
    some = [[rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)] for _ in range(4)]
    rows = [(i, rng.choice(some), rng.randrange(2)) for i in range(150)]
    rows += rows[:40] + [(10, [0.0, 0.5, 0.25], 1), (10, [0.0, 0.5, 0.25], 0), (11, [1.0, 1.0, 1.0], 0)]
    assert got(spark, rows, every=10, block=5, pivots=4) == brute(rows, every=10) != []


def test_rows_that_take_no_part(spark):
    rows = vectors(60, 3, 9)
    odd = [(None, [1.0, 0.0, 0.0], 1), (100, None, 1), (110, [1.0, None, 0.0], 1), (120, [1.0, math.nan, 0.0], 1), (130, [math.inf, 0.0, 0.0], 1), (140, [1.0, 0.0, 0.0], None), (150, [1e307, 0.0, 0.0], 1)]
    assert got(spark, rows + odd, every=10) == brute(rows, every=10) != []


def test_short_empty_and_huge_vectors(spark):
    rows = vectors(30, 3, 4)
    uneven = rows + [(70, [], 0), (71, [0.5], 1), (80, [0.25, 0.5], 0)]
    filled = [(i, x + [0.0] * (3 - len(x)), n) for i, x, n in uneven]
    assert got(spark, uneven, every=10) == brute(filled, every=10) != []
    huge = rows + [(90, [1e200, -1e200, 3.0], 0), (91, [1e200, 1.0, 1e100], 0), (92, [1e200, 1.0, 2e100], 1), (93, [2.0**51 + 0.5, 1.0, 1.0], 1)]
    assert got(spark, huge, every=10) == brute(huge, every=10)


def test_few_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, [1.0], 1)]) == []
    assert got(spark, [(100, [1.0], 1)]) == []
    assert got(spark, [(100, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]) == [(100, 1, 1, 2, 65536, 32768)]


def test_packed_cells():
    pivots = np.array([[0.0, 0], [1, 0], [9, 0], [2, 0]])
    assert H.packed(pivots, np.array([3, 3, 3, 3]), 6).tolist() == [0, 0, 1, 1]
