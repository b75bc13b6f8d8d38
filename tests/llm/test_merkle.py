import hashlib
import random
import zlib

import pytest

from querent.llm import merkle

DDL = "doc_id long, text string, lang string, source string, n_chars long, place int, tree string"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes, fanout):
    """Levels from ``nodes`` to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([digest("".join(low[i : i + fanout])) for i in range(0, len(low), fanout)])
    return levels


def brute(rows, fanout):
    """(doc_id, leaf, subroot, root, proof, folded, verified) by plain lists."""
    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        trees.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf_of(doc_id, source, lang, n_chars, text), doc_id, text, lang, n_chars))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: climb([r[2] for r in sorted(trees[s], key=lambda r: r[:3])], fanout) for s in order}
    top, out = climb([levels[s][-1][0] for s in order], fanout), []
    for k, s in enumerate(order):
        for i, (_, _, leaf, doc_id, text, lang, n_chars) in enumerate(sorted(trees[s], key=lambda r: r[:3])):
            cut = text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text
            fold, proof = leaf_of(doc_id, s, lang, n_chars, cut), ""
            for at, tree in ((i, levels[s]), (k, top)):
                for level in tree[:-1]:
                    start = at // fanout * fanout
                    before, after = "".join(level[start:at]), "".join(level[at + 1 : start + fanout])
                    fold, proof, at = digest(before + fold + after), proof + before + after, at // fanout
            out.append((doc_id, leaf, levels[s][-1][0], top[-1][0], digest(proof), fold, fold == top[-1][0]))
    return out


def got(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 9, "clash") for r in rows], DDL).repartition(3)
    return sorted(map(tuple, merkle.manifest(df, **kw).collect()), key=repr)


def case(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "\n", f"a{i}\nb", f"é{i} " * 3, f"line {i}\n\nmore"])
        rows.append((i * 7 % 1000, text, rng.choice(["en", None]), rng.choice(["hot"] * 6 + [None, "", "ä", "z", "Z"]), rng.choice([None, i])))
    return rows


@pytest.mark.parametrize(("n", "fanout", "depth"), [(1, 3, 8), (4, 3, 8), (200, 3, 8), (200, 3, 1), (200, 2, 2), (90, 3, 2)])
def test_equals_brute_force(spark, n, fanout, depth):
    """Shallow blocks make trees of many passes, of leaves and of sources."""
    rows = case(n)
    assert got(spark, rows, fanout=fanout, depth=depth) == sorted(brute(rows, fanout), key=repr)


def test_many_sources(spark):
    rows = [(i, f"x\n{i}", "en", f"s{i % 37}", 3) for i in range(80)]
    assert got(spark, rows, depth=1) == sorted(brute(rows, 3), key=repr)


def test_ties_nulls_and_repeated_rows(spark):
    rows = [(None, "a\nb", None, None, None), (None, None, None, None, None), (5, "t\n", "en", "s", 2), (5, "t\n", "en", "s", 2), (5, "u\n", "en", "s", 2), (6, "", "", "", 0)]
    out = got(spark, rows)
    assert len(out) == 6 and {r[6] for r in out if r[0] is None} == {True}
    # rows that repeat have equal leaves; their two places give two proofs
    assert out == sorted(brute(rows, 3), key=repr)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_long_text(spark):
    rows = [(1, "long\n" * 400_000, "en", "s", 1), (2, "short", "en", "s", 1)]
    assert got(spark, rows) == sorted(brute(rows, 3), key=repr)
