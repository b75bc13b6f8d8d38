"""Execution accuracy: both queries run on Spark under a deadline, results compared."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querent.operators.exact import normalise
from querent.plans.compiler import Catalog, compile_query
from querent.plans.ir import Query
from querent.plans.parser import parse


#: Rows of a result that may go to the driver; larger ones are compared where they are.
MOST_ROWS = 100_000


@dataclass
class Ran:
    rows: list[tuple] | None
    error: str | None
    timeout: bool
    more: bool = False


def under_deadline(spark: SparkSession, work: Callable[[], object], seconds: float, poll: float = 0.2) -> tuple[object, str | None, bool]:
    """What ``work()`` returns, or the error, and whether it came too late.

    Jobs run in a group of their own.  After the deadline the group is cancelled
    again and again until the thread ends: a single cancel is lost when it falls
    between two jobs.
    """
    if seconds <= 0:
        raise ValueError("timeout_seconds must be greater than 0")
    group, done, errors = f"deadline-{uuid.uuid4().hex}", [], []

    def run() -> None:
        spark.sparkContext.setJobGroup(group, "query under a deadline", interruptOnCancel=True)
        try:
            done.append(work())
        except Exception as e:  # noqa: BLE001  any failure of the query is its result
            errors.append(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")

    thread, late = threading.Thread(target=inheritable_thread_target(spark)(run), daemon=True), False
    until = time.monotonic() + seconds
    thread.start()
    thread.join(seconds)
    while thread.is_alive():
        late = True
        spark.sparkContext.cancelJobGroup(group)
        thread.join(poll)
    error = errors[0] if errors else None
    return done[0] if done else None, error, late or (error is not None and time.monotonic() >= until and "cancel" in error.lower())


def run_with_deadline(spark: SparkSession, make: Callable[[], object], seconds: float, most_rows: int = MOST_ROWS, poll: float = 0.2) -> Ran:
    """Rows of ``make()`` (a DataFrame), or the error, or a timeout; of more rows than ``most_rows`` none, and ``more`` is set."""
    rows, error, late = under_deadline(spark, lambda: make().limit(most_rows + 1).collect(), seconds, poll)  # type: ignore[attr-defined]
    more = rows is not None and len(rows) > most_rows  # type: ignore[arg-type]
    return Ran(None if rows is None or more else [tuple(r) for r in rows], error, late, more)  # type: ignore[attr-defined]


def result_map(rows: list[tuple], q: Query) -> dict:
    """Values by column: the key leaves the outer aggregate out, and equal keys overwrite."""
    return {(v.left if v.right is None else v): [r[i] for r in rows] for i, (_, v) in enumerate(q.items)}


def same_result(pred_rows: list[tuple], gold_rows: list[tuple], pred: Query, gold: Query, ordered: bool = True) -> bool:
    """Equal maps: column order never counts.

    ``ordered`` compares row order too, as the measure is defined; without it,
    rows of the mapped columns are compared as a multiset.
    """
    p, g = result_map(pred_rows, pred), result_map(gold_rows, gold)
    if ordered or set(p) != set(g):
        return p == g
    order = sorted(g, key=repr)
    rows = lambda m: sorted(zip(*(m[k] for k in order), strict=True), key=repr)
    return rows(p) == rows(g)


def plain_value(c: Column, kind: T.DataType) -> Column:
    """A value as text, equal for values that compare equal: 1, 1.0 and true are one."""
    if isinstance(kind, T.BooleanType):
        c = c.cast("int")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(c.isNull(), "-").when((c == F.floor(c)) & (F.abs(c) < 1e15), F.concat(F.lit("n"), c.cast("decimal(38, 0)").cast("string"))).otherwise(F.concat(F.lit("n"), c.cast("double").cast("string")))
    mark = "n" if isinstance(kind, (T.NumericType, T.BooleanType)) else "t"
    return F.when(c.isNull(), "-").otherwise(F.concat(F.lit(mark), c.cast("string")))


def digest(df: DataFrame, q: Query, ordered: bool) -> DataFrame:
    """One row: the number of rows and a 128-bit sum of hashes of the mapped columns.

    With ``ordered`` each row's hash has its position in it: the rows before its
    partition are counted first, so no row moves.
    """
    at = {(v.left if v.right is None else v): i for i, (_, v) in enumerate(q.items)}
    named = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    values = [plain_value(F.col(f"c{at[k]}"), df.schema[at[k]].dataType) for k in sorted(at, key=repr)]
    if ordered:
        named = named.withColumn("pid", F.spark_partition_id()).withColumn("id", F.monotonically_increasing_id())
        sizes = named.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).collect()
        start, before = {}, 0
        for r in sorted(sizes, key=lambda r: r.pid):
            start[r.pid], before = before, before + r.n
        starts = F.array(*(F.lit(start.get(i, before)).cast("long") for i in range(max(start, default=-1) + 1)))
        values.append((F.get(starts, F.col("pid")) + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).cast("string"))
    halves = [F.sum(F.xxhash64(F.lit(seed), *values).cast("decimal(38, 0)")) for seed in (1, 2)]
    return named.agg(F.count(F.lit(1)), *halves)


def evaluate_pair(spark: SparkSession, i: int, db_id: str, gold_sql: str, pred_sql: str, catalog: Catalog, keys: Mapping[str, str], seconds: float, ordered: bool, most_rows: int = MOST_ROWS) -> dict:
    ran = {name: run_with_deadline(spark, lambda sql=sql: compile_query(spark, sql, catalog), seconds, most_rows) for name, sql in (("pred_sql", pred_sql), ("gold_sql", gold_sql))}
    errors = [f"{name}: {r.error}" for name, r in ran.items() if r.error]
    match, late = False, False
    if not errors:
        try:
            pred, gold = (normalise(parse(sql, catalog.names), catalog.names, keys) for sql in (pred_sql, gold_sql))
            if not any(r.more for r in ran.values()):
                match = same_result(ran["pred_sql"].rows or [], ran["gold_sql"].rows or [], pred, gold, ordered)
            elif all(r.more for r in ran.values()) and set(result_map([], pred)) == set(result_map([], gold)):
                sums = [run_with_deadline(spark, lambda sql=sql, q=q: digest(compile_query(spark, sql, catalog), q, ordered), seconds) for sql, q in ((pred_sql, pred), (gold_sql, gold))]
                late = any(r.timeout for r in sums)
                errors += [f"{name}: {r.error}" for name, r in zip(ran, sums, strict=True) if r.error]
                match = not errors and sums[0].rows == sums[1].rows
        except Exception as e:  # noqa: BLE001  reported in the details
            errors.append(f"parse_or_compare: {type(e).__name__}: {e}")
    return {"id": i, "db_id": db_id, "pred_sql": pred_sql, "gold_sql": gold_sql, "exec_match": match, "error": "; ".join(errors) or None, "timeout": late or any(r.timeout for r in ran.values())}


def evaluate(spark: SparkSession, gold: list[tuple[str, str]], predictions: list[str], catalogs: Mapping[str, Catalog], keys: Mapping[str, Mapping[str, str]], timeout_seconds: float = 30.0, ordered: bool = True, parallel: int = 4, most_rows: int = MOST_ROWS) -> tuple[dict, list[dict]]:
    """Scores and aligned details; queries are launched from a small thread pool."""
    if len(gold) != len(predictions):
        raise ValueError(f"Prediction count ({len(predictions)}) != gold count ({len(gold)})")
    if timeout_seconds <= 0:
        raise ValueError("timeout_seconds must be greater than 0")
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        jobs = [pool.submit(evaluate_pair, spark, i, db, sql, pred, catalogs[db], keys.get(db, {}), timeout_seconds, ordered, most_rows) for i, ((sql, db), pred) in enumerate(zip(gold, predictions, strict=True))]
        details = [j.result() for j in jobs]
    matches = sum(d["exec_match"] for d in details)
    return {"all": {"count": len(details), "execution_accuracy": matches / len(details) if details else 0.0}}, details
