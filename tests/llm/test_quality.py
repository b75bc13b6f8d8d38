import random
import zlib

import numpy as np
import pytest

from querent.llm import quality

from .conftest import prose


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(240):
        good = rng.random() < 0.7
        text = prose(rng, 40)
        rows.append((i, text if good else text.upper().replace(" ", "!! "), "x"))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality string").cache(), spark.createDataFrame(labels, "doc_id long, quality int").cache()


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels, bits=12)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    want = {r.doc_id: r.quality for r in labels.collect()}
    held = [d for d in want if zlib.crc32(str(d).encode()) % 5 == 0]
    assert len(held) > 20 and np.mean([(got[d] >= 0.5) == bool(want[d]) for d in held]) > 0.95
    kept = {r.doc_id for r in quality.accept(docs, model, 0.5).collect()}
    assert kept == {d for d, s in got.items() if s >= 0.5}
    assert quality.accept(docs, model).columns == docs.columns


def test_held_out_rows_teach_nothing(spark, labelled):
    docs, labels = labelled
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0, 1 - quality, quality) AS quality")
    a, b = quality.fit(docs, labels, bits=10), quality.fit(docs, turned, bits=10)
    assert a.bias == b.bias and (a.weight == b.weight).all()


def test_odd_rows(spark, labelled, empty):
    docs, labels = labelled
    none = quality.fit(docs, labels.limit(0), bits=10)
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    model = quality.fit(docs, labels.union(labels), bits=10)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "x" * 300_000)], "doc_id long, text string")
    out = {r.doc_id: r.score for r in quality.score(odd, model).collect()}
    assert out[1] == out[2] and all(0 <= s <= 1 for s in out.values()) and len(out) == 4
    assert quality.score(empty, model).count() == 0 and quality.accept(empty, model).count() == 0


def test_scores_equal_the_plain_sum():
    rng = np.random.default_rng(1)
    model = quality.Model(8, rng.standard_normal(256).astype(np.float32), 0.3)
    texts = [b"", b"a", b"some words here", "é à ü".encode(), b"x " * 50]
    got = quality.scores(model, texts)
    for i, t in enumerate(texts):
        kinds = list(quality.spans([t], 8))
        w = np.concatenate([model.weight[b[f[0] : l[0]]].astype(float) for b, f, l in kinds])
        z = (w.mean() if len(w) else 0) + model.bias
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_repeated_documents(labelled):
    """A document that repeats is scored each time, alike, and teaches what one does."""
    docs, labels = labelled
    twice = docs.union(docs)
    model = quality.fit(twice, labels, bits=10)
    scores = {}
    for r in quality.score(twice, model).collect():
        scores.setdefault(r.doc_id, []).append(r.score)
    assert all(len(v) == 2 and v[0] == v[1] for v in scores.values()) and len(scores) == 240
    want = {r.doc_id: r.quality for r in labels.collect()}
    assert np.mean([(v[0] >= 0.5) == bool(want[d]) for d, v in scores.items()]) > 0.95
    kept = [r.doc_id for r in quality.accept(twice, model, 0.5).collect()]
    assert sorted(kept) == sorted(d for d, v in scores.items() for _ in v if v[0] >= 0.5)
