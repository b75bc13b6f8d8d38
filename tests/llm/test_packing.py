import zlib

import numpy as np
import pytest

from querent.llm.packing import SumOfSquares, WordEncoder, default_tokenizer, pack

ODD = ["", "Hello, World! it's we'll 'sto 12,345 3.5", "ÀÉÎõü ß µ ª º ½ ² ×÷", "ΑΣ σς İ ı", "naïve – “quotes” … 日本語 emoji 🙂", "a b\x1cc\x0bd\x85e", "<|startoftext|>x<|endoftext|>", "é combining", "tab\tnew\nline\r\n", "DON'T CAN'T I'VE", "x" * 5000, "_under_ (brackets) [a] {b} #1 @me $5 100% a/b\\c"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def test_encoder_equals_the_library(reference, rows):
    texts = ODD + [t or "" for _, t in rows]
    own = WordEncoder(default_tokenizer(), memo=50)
    for _ in range(2):
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids, text[:50]


@pytest.mark.parametrize("group", [40_000, 9])
def test_pieces_partition_the_ids(docs, rows, reference, group):
    out = pack(docs, capacity=256, group=group).toPandas()
    want = {i: np.array([*reference.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    assert set(out.doc_id) == set(want)
    for d, p in out.groupby("doc_id"):
        p = p.sort_values("start")
        assert p.start.tolist() == [0, *p.length.cumsum()[:-1].tolist()] and p.length.sum() == len(want[d])
        for r in p.itertuples():
            assert r.doc_tokens == len(want[d]) and r.ids_crc32 == zlib.crc32(want[d][r.start : r.start + r.length].tobytes())
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1].tolist()] and s.length.sum() <= 256


def test_repeated_rows_and_empty_tables(spark, empty):
    assert pack(empty).count() == 0
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.length) for r in pack(df).collect()) == [(0, 1), (1, 3), (1, 3)]


def test_sum_of_squares_wastes_little():
    rng = np.random.default_rng(2)
    packer, full, total = SumOfSquares(100, 0), 0, 0
    for i, s in enumerate(rng.integers(1, 100, 20_000).tolist()):
        total += s
        full += packer.place(s, (i, 0, s)) is not None
    windows = full + sum(1 for _ in packer.open())
    assert total / (windows * 100) > 0.98
