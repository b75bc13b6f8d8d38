import numpy as np
import pytest

from querent.llm.ann import build_graph, packed, search


def brute(rows, every, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ok:
        if q % every == 0:
            out[q] = sorted((float(np.sqrt(((ok[q] - v) ** 2).sum())), i) for i, v in ok.items() if i != q)[:k]
    return out


def compare(rows, got, every=10, k=5):
    want = brute(rows, every, k)
    hits = total = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == {q for q in want if want[q]}
    vec = dict(rows)
    for q, found in by.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(want[q]) + 1))
        assert found == sorted(found, key=lambda x: (x[2], x[1]))
        for _, i, s in found:
            assert abs(s - np.sqrt(((np.array(vec[q]) - np.array(vec[i])) ** 2).sum())) < 1e-12
        hits += len({i for _, i, _ in found} & {i for _, i in want[q]})
        total += len(want[q])
    return hits / max(1, total)


DDL = "vec_id long, embedding array<double>, label int"


def test_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 24)) + 2 * rng.standard_normal((8, 24))[rng.integers(0, 8, 1500)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, 1) for r in rows], DDL)
    assert compare(rows, search(df, every=10, k=5).collect()) >= 0.9


def test_equal_and_unusable_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0] + [0.0] * 5) for i in range(40)]
    rows += [(200, None), (210, [0.0] * 6), (220, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (230, [float("nan")] + [1.0] * 5), (240, [float("inf")] + [1.0] * 5), (250, []), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], DDL)
    assert compare(rows, search(df, every=10, k=5).collect()) == 1.0


@pytest.mark.parametrize("n", [0, 1, 3])
def test_small_tables(spark, n):
    rows = [(10 * i, [float(i + 1), 1.0]) for i in range(n)]
    df = spark.createDataFrame([(*r, 1) for r in rows], DDL)
    assert compare(rows, search(df, every=10, k=5).collect()) in (0, 1.0)


def uniform(n, dim=32, seed=6):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_beam_grows_until_recall_is_met(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(uniform(1500))]
    df = spark.createDataFrame([(*r, 1) for r in rows], DDL)
    assert compare(rows, search(df, every=10, k=5, beam=8, expand=4).collect()) >= 0.9


def test_graph_rounds_go_on_until_edges_settle(spark):
    x = uniform(1200)
    nodes = spark.createDataFrame([(i, bytearray(q)) for i, q in enumerate(packed(x))], "node long, q binary").cache()
    got = build_graph(nodes, len(x), k=10, leaf=16, sample=3)
    assert got.filter("fresh").count() <= 0.002 * 10 * len(x)
    with pytest.raises(RuntimeError):
        build_graph(nodes, len(x), k=10, leaf=16, sample=3, most_rounds=1)


def test_mixed_lengths_repeated_ids_and_clashing_columns(spark):
    """The commonest length counts; of one id's vectors the smallest; other columns are not read."""
    x = uniform(80, dim=4)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(500 + i, [1.0] * 3) for i in range(20)] + [(10, [9.0] * 4)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows + odd], "vec_id long, embedding array<double>, w int, node int, q int")
    want = dict(rows)
    want[10] = min(want[10], [9.0] * 4)
    assert compare(list(want.items()), search(df, every=10, k=5).collect()) >= 0.9
