"""Shared plumbing of the corpus operators: scratch tables, hashing, components."""

from __future__ import annotations

import ctypes
import gc
import os
import time
import uuid
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a session without that setting (a local test) gets a folder under
    the warehouse, which Spark itself requires to be shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete all tables of ``materialize`` of this application, once results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, heavy: bool = False) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder.

    Later stages restart from files that outlive any executor.  Shuffle files of
    plans that nothing refers to any more are let go, which otherwise waits for
    the driver's next full collection: rounds of joins would pile them up.  With
    ``heavy``, for shuffles as large as the input, that is waited for where the
    table took long to write.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    began = time.monotonic()
    df.write.option("compression", "zstd").parquet(path)
    for wait in (0, 0.5, 1) if heavy and time.monotonic() - began > 5 else (0,):
        time.sleep(wait)
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path  # type: ignore[attr-defined]
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no result still to be read depends on."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)  # type: ignore[attr-defined]
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spare(name: str, *frames: DataFrame) -> str:
    """A name for a helper column that no column of ``frames`` has, in any case of letters."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# --- memory of Python workers ---------------------------------------------


@cache
def _trim() -> Callable[[int], int] | None:
    """``malloc_trim`` where the C library has it."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def _resident() -> float:
    """Bytes of memory this process holds, shared pages left out; infinite where the system does not tell."""
    try:
        with open("/proc/self/statm") as f:
            _, resident, shared, *_ = map(int, f.read().split())
        return (resident - shared) * os.sysconf("SC_PAGE_SIZE")
    except (OSError, ValueError):
        return float("inf")


def lean(work: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """Batch work that gives its memory back at the end of each task.

    Python workers are used again by later stages; what they keep would stand
    beside the memory of those.
    """

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch], *args, **kw) -> Iterator[pa.RecordBatch]:
        yield from work(batches, *args, **kw)
        if _resident() < 100e6:
            return
        for key in _pow:
            _pow[key] = np.ones(1, np.uint64)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := _trim():
            trim(0)

    return run


# --- 64-bit mixing -------------------------------------------------------

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x2545F4914F6CDD1D
_pow: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_pow["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _pow[key] = np.multiply.accumulate(a)
    return _pow["up"][:n], _pow["down"][:n]


def prefix_poly(buf: np.ndarray) -> np.ndarray:
    """p[i] = sum of (buf[j] + 1) * base**j for j < i, modulo 2**64."""
    up, _ = powers(len(buf))
    p = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up, out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free polynomial hash of each buf[start:end]."""
    _, down = powers(len(p))
    return mix64((p[end] - p[start]) * down[start] + (end - start).astype(np.uint64) * GOLDEN)


def chunks(lengths: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices whose lengths sum to ``most`` or that hold one item."""
    start = total = 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield slice(start, len(lengths))


def text_bytes(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text of an Arrow column; null counts 0."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_parts(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[list[str | None]]:
    """The texts of a column in order, in lists of about ``most`` bytes."""
    texts = batch.column(column)
    for part in chunks(text_bytes(texts) + 1, most):
        yield texts.slice(part.start, part.stop - part.start).to_pylist()


def encode(texts: list[str | None]) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8") for t in texts]


def batches_of(rows: dict[str, list], schema: pa.Schema, at_most: int = 20_000) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(rows.values())))
    for i in range(0, n, at_most):
        yield pa.RecordBatch.from_arrays([pa.array(rows[f.name][i : i + at_most], f.type) for f in schema], schema=schema)


# --- connected components ------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of undirected ``edges`` (a, b); component is the smallest node.

    Alternating large-star and small-star: each round halves path lengths, is
    two aggregations and joins, and keeps at most as many edges as before.
    A hub is a join key, not a collected list, so skew is split by AQE.
    Nodes without an edge do not appear.  Rounds end when the edges are stars.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").filter("a <> b").distinct()
        old, e = e, materialize(star, "edges")
        discard(old)
        now = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
