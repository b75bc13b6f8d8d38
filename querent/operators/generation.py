"""Answers of a language model to many prompts, in batches of like length, resumed where a run ended."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.operators.matching import encoder_of
from querent.sources.files import exists

_ANSWERS = pa.schema([("id", pa.int64()), ("answer", pa.string())])

#: From a list of chats, each a list of {role, content}, to as many answers.
Generator = Callable[[list[list[dict[str, str]]]], list[str]]


def batches_by_size(lengths: list[int], most: int, budget: int) -> Iterator[tuple[int, int]]:
    """Consecutive (start, end) of at most ``most`` items whose padded size, count times the longest, is in the budget; an item beyond it is alone."""
    start = longest = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start == most or max(longest, n) * (i - start + 1) > budget):
            yield start, i
            start, longest = i, 0
        longest = max(longest, n)
    if lengths:
        yield start, len(lengths)


def _generate(batches: Iterator[pa.RecordBatch], model: str, load: Callable[[str], Generator], most: int, budget: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, messages, length), by length: answers batch by batch."""
    generator = encoder_of(f"generator:{model}", lambda _: load(model))
    for batch in batches:
        ids, chats, lengths = (c.to_pylist() for c in batch.columns)
        for start, end in batches_by_size(lengths, most, budget):
            answers = generator(chats[start:end])
            if len(answers) != end - start:
                raise ValueError(f"{len(answers)} answers to {end - start} prompts")
            yield pa.RecordBatch.from_arrays([pa.array(ids[start:end], pa.int64()), pa.array(answers, pa.string())], schema=_ANSWERS)


def answered(prompts: DataFrame, path: str) -> DataFrame:
    """(id, answer) written so far; none where there is no folder yet."""
    spark = prompts.sparkSession
    if not exists(spark, path):
        return spark.createDataFrame([], "id long, answer string")
    return spark.read.schema("id long, answer string").parquet(path)


def generate(prompts: DataFrame, path: str, model: str, load: Callable[[str], Generator], batch_size: int = 32, budget: int = 1 << 18, rounds: int = 8, tasks: int | None = None) -> DataFrame:
    """(id, answer) of prompts (id, messages), kept in the Parquet folder ``path``.

    ``load(model)`` runs once on each worker and gives the model.  Prompts that
    ``path`` has an answer to are left out by an anti-join, so a run that was
    killed goes on where it ended: answers are written in ``rounds``, each
    committed as a whole, of prompts dealt by a hash of their id.  In a round
    prompts are dealt to tasks by ranges of their length, so the batches of a
    task (``batch_size`` prompts, and ``budget`` characters when padded to the
    longest) hold prompts of like length.  Prompts of equal ids are one; null
    ids and prompts without messages take no part.
    """
    spark = prompts.sparkSession
    tasks = tasks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    wanted = prompts.filter("id IS NOT NULL AND size(messages) > 0").select(F.col("id").cast("long").alias("id"), "messages").dropDuplicates(["id"])
    size = F.aggregate("messages", F.lit(0), lambda n, m: n + F.length(m["content"]))
    for part in range(rounds):
        own = wanted.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == part)
        left = own.join(answered(prompts, path).select("id"), "id", "left_anti").withColumn("size", size)
        if left.isEmpty():
            continue
        dealt = left.repartitionByRange(tasks, "size", "id").sortWithinPartitions("size", "id")
        dealt.select("id", "messages", "size").mapInArrow(partial(_generate, model=model, load=load, most=batch_size, budget=budget), "id long, answer string").write.mode("append").parquet(path)
    return answered(prompts, path)
