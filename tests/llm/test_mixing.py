from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from querent.llm import mixing


def test_solve_meets_its_targets():
    tokens = np.array([5000, 500, 300, 200, 0])
    even = mixing.solve(tokens, max_repeats=1e9)
    assert even.exponent == 0 and np.allclose(even.weights[:4], 0.25)
    m = mixing.solve(tokens, max_repeats=3)
    assert abs((m.budget * m.weights[:4] / tokens[:4]).max() - 3) < 1e-6 and abs(m.budget * m.weights[0] - 5000) < 1e-6
    share = 0.9
    m = mixing.solve(tokens, entropy_share=share, max_repeats=1e9)
    assert abs(mixing.entropy(m.weights) - share * np.log(4)) < 1e-6
    fixed = mixing.solve(tokens, max_repeats=2, budget=4000.0)
    assert fixed.budget == 4000 and (4000 * fixed.weights[:4] / tokens[:4]).max() <= 2 + 1e-6
    assert mixing.solve(np.array([0, 0])).budget == 0 and mixing.solve(np.zeros(0)).budget == 0


def _docs(spark):
    rows = [(i, "x" * (4 * (1 + i % 7)), "big" if i < 300 else f"s{i % 4}" if i < 398 else None) for i in range(400)]
    return spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, mix_pass int").repartition(3)


@pytest.mark.parametrize("block_rows", [2000, 5])
def test_realised_budgets(spark, block_rows):
    df = _docs(spark)
    out = mixing.mix(df, max_repeats=2.5, block_rows=block_rows).toPandas()
    tokens = {r.doc_id: (r.source, len(r.text) // 4) for r in df.collect()}
    have = Counter()
    for s, t in tokens.values():
        have[s] += t
    keys = sorted(have, key=lambda s: (s is not None, s or ""))
    m = mixing.solve(np.array([have[k] for k in keys]), max_repeats=2.5)
    got = Counter()
    for d, p in zip(out.doc_id, out.mix_pass, strict=True):
        got[tokens[d][0]] += tokens[d][1]
    for k, w in zip(keys, m.weights, strict=True):
        assert m.budget * w - 8 <= got[k] <= m.budget * w + 1
    assert set(out.doc_id) == set(tokens)  # every document at least once
    assert not out.duplicated(["doc_id", "mix_pass"]).any()
    passes = out.groupby("doc_id").mix_pass.apply(sorted)
    assert all(p == list(range(len(p))) for p in passes)


def test_downsampling_keeps_to_the_budget(spark):
    out = mixing.mix(_docs(spark), max_repeats=1.0, budget=500.0, block_rows=20).toPandas()
    assert 500 - 8 * 6 <= out.mix_tokens.sum() <= 506 and not out.duplicated("doc_id").any()


def test_odd_tables(spark, empty):
    assert mixing.mix(empty).count() == 0
    df = spark.createDataFrame([(1, None, None), (1, None, None), (None, "", "a")], "doc_id long, text string, source string")
    assert mixing.mix(df, max_repeats=1.0).count() == 3
    with pytest.raises(ValueError):
        mixing.mix(df, most_sources=1)


@pytest.mark.parametrize(("block_rows", "repeats", "budget"), [(2000, 2.5, None), (7, 1.5, None), (3, 3.2, None), (11, 1.0, 700.0)])
def test_every_row_equals_brute_force(spark, block_rows, repeats, budget):
    """Each pass of each document, by hand from the same hashes."""
    df, seed = _docs(spark), 17
    label = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    base = df.select("doc_id", label.alias("s"), (F.length("text") / 4).cast("int").alias("t"), F.xxhash64(F.lit(seed), "doc_id").alias("key"))
    rows = base.withColumn("second", F.xxhash64(F.lit(seed + 2), "key")).collect()
    names = sorted({r.s for r in rows})
    have = np.array([sum(r.t for r in rows if r.s == s) for s in names])
    m = mixing.solve(have, max_repeats=repeats, budget=budget)
    want = []
    for s, tokens, w in zip(names, have.tolist(), m.weights.tolist(), strict=True):
        own = [r for r in rows if r.s == s]
        passes = m.budget * w / tokens
        whole = int(passes + 1e-9)
        want += [(r.doc_id, p) for r in own for p in range(whole)]
        part, n = (round((passes - whole) * tokens) if passes > whole + 1e-9 else 0), max(1, -(-len(own) // block_rows))
        places = {r.b: r.p for r in spark.range(n).select(F.col("id").alias("b"), F.xxhash64(F.lit(seed + 1), F.lit(s), "id").alias("p")).collect()}
        left = part
        for b in sorted(places, key=lambda b: (places[b], b)):
            block = sorted((r for r in own if r.key % n == b), key=lambda r: (r.second, r.doc_id))
            if left <= 0:
                break
            taken = 0
            for r in block:
                taken += r.t
                if taken <= left:
                    want.append((r.doc_id, whole))
            left -= sum(r.t for r in block)
    got = mixing.mix(df, max_repeats=repeats, budget=budget, block_rows=block_rows).select("doc_id", "mix_pass").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_helper_names_may_be_taken(spark):
    rows = [(i, "word " * 9, f"s{i % 2}", i, i, i, i, i) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _block int, _KEY int, doc int, _part int, before int")
    out = mixing.mix(df, max_repeats=1.0)
    assert out.columns == [*df.columns, "mix_pass", "mix_tokens", "mix_order"]
    assert sorted(tuple(r)[:8] for r in out.collect()) == rows
