import os

import pytest
from pyspark.sql import functions as F

from querent.operators import generation, prompts


def asked(spark, texts, ids=None):
    df = spark.createDataFrame(list(zip(ids or range(len(texts)), texts, strict=True)), "id long, text string")
    return df.select("id", F.when(F.col("text").isNotNull(), prompts.messages(F.col("text"))).alias("messages"))


def test_batches():
    assert list(generation.batches_by_size([], 3, 100)) == []
    assert list(generation.batches_by_size([1, 1, 1, 1], 3, 100)) == [(0, 3), (3, 4)]
    assert list(generation.batches_by_size([10, 20, 60, 200, 5], 9, 100)) == [(0, 2), (2, 3), (3, 4), (4, 5)]


def test_batches_hold_like_lengths(spark, tmp_path):
    """Padding is little: the longest prompt of a batch is near the others."""
    texts = ["x" * (1 + i * 37 % 997) for i in range(400)]

    def load(model):
        return lambda chats: [f"{len(c[-1]['content'])} of {max(len(d[-1]['content']) for d in chats)}" for c in chats]

    out = [tuple(map(int, r.answer.split(" of "))) for r in generation.generate(asked(spark, texts), str(tmp_path / "a"), "m", load, batch_size=16, rounds=1, tasks=2).collect()]
    assert sorted(n for n, _ in out) == sorted(map(len, texts))
    assert sum(m for _, m in out) < 1.1 * sum(n for n, _ in out)


def test_killed_and_resumed(spark, tmp_path):
    """A run that dies keeps the rounds it wrote; the next asks only for the rest, and each prompt is asked once."""
    folder, log = str(tmp_path / "answers"), tmp_path / "log"
    log.mkdir()
    texts = [f"prompt {i}" for i in range(60)]
    bad = spark.range(60).filter("pmod(xxhash64(id), 6) = 3").first().id

    def load_fragile(model):
        def run(chats):
            if any(c[-1]["content"] == f"prompt {bad}" for c in chats):
                raise RuntimeError("killed")
            return [c[-1]["content"].upper() for c in chats]

        return run

    with pytest.raises(Exception, match="killed"):
        generation.generate(asked(spark, texts), folder, "fragile", load_fragile, rounds=6)
    before = {r.id for r in generation.answered(asked(spark, texts), folder).collect()}
    assert bad not in before

    where = str(log)

    def load_sound(model):
        def run(chats):
            for c in chats:
                with open(os.path.join(where, c[-1]["content"].split()[1]), "a") as f:
                    f.write("x")
            return [c[-1]["content"].upper() for c in chats]

        return run

    out = {r.id: r.answer for r in generation.generate(asked(spark, texts), folder, "sound", load_sound, rounds=6).collect()}
    assert out == {i: t.upper() for i, t in enumerate(texts)}
    assert {int(p.name) for p in log.iterdir()} == set(range(60)) - before and before
    assert all(p.read_text() == "x" for p in log.iterdir())


def test_odd_prompts(spark, tmp_path):
    def load(model):
        return lambda chats: [c[-1]["content"] for c in chats]

    df = asked(spark, ["a", "a", "b", None, "", "z"], [1, 1, 2, 3, 4, None])
    assert sorted(map(tuple, generation.generate(df, str(tmp_path / "a"), "odd", load).collect())) == [(1, "a"), (2, "b"), (4, "")]
    assert generation.generate(df.limit(0), str(tmp_path / "b"), "odd", load).collect() == []

    def short(model):
        return lambda chats: []

    with pytest.raises(Exception, match="0 answers to"):
        generation.generate(df, str(tmp_path / "c"), "short", short)
