"""Reports over runs: exact match by level, execution, deltas, the best run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.operators.exact import LEVELS


def match_report(examples: DataFrame, details: DataFrame) -> DataFrame:
    """Examples with their scores, joined by position.

    examples(id, example_id, question, gold_sql, pred_sql, raw_output, hints) and
    details of ``score_pairs``; a missing example_id is made from the position.
    """
    e = examples.withColumn("example_id", F.coalesce("example_id", F.concat(F.lit("example-"), F.col("id").cast("string"))))
    d = details.select("id", "db_id", "hardness", "exact_match", F.col("error").alias("parse_error"))
    return e.join(d, "id").select("id", "example_id", "db_id", "question", "gold_sql", "pred_sql", "raw_output", "hardness", "exact_match", "hints", "parse_error")


def execution_summary(details: DataFrame) -> DataFrame:
    """One row: count, matches, errors, timeouts, execution_accuracy."""
    return details.agg(
        F.count(F.lit(1)).alias("count"), F.count_if("exec_match").alias("matches"),
        F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if("timeout").alias("timeouts"),
        F.coalesce(F.avg(F.col("exec_match").cast("int")), F.lit(0.0)).alias("execution_accuracy"),
    )


def delta_table(baseline: DataFrame, augmented: DataFrame) -> DataFrame:
    """(model, n, em, ex, d_em, d_ex) of two runs' (model, n, em, ex): all augmented models."""
    b = baseline.select("model", F.col("em").alias("base_em"), F.col("ex").alias("base_ex"))
    return augmented.join(b, "model", "left").select("model", "n", "em", "ex", (F.col("em") - F.col("base_em")).alias("d_em"), (F.col("ex") - F.col("base_ex")).alias("d_ex"))


def best_run(runs: DataFrame, primary: str = "execution_accuracy", secondary: str = "exact_match", order: str = "model") -> DataFrame:
    """The run that is best by (primary, secondary), nulls as -1; ties to the first in order."""
    place = F.struct(F.coalesce(primary, F.lit(-1.0)).alias("p"), F.coalesce(secondary, F.lit(-1.0)).alias("s"))
    top = runs.withColumn("_k", place).orderBy(F.desc("_k"), order).limit(1)
    return top.drop("_k")


def difficulty_report(scores: list[dict]) -> dict:
    """by_difficulty of collected level scores: levels that occur, in their order."""
    by = {s["hardness"]: s for s in scores}
    return {k: {"count": by[k]["count"], "exact_match": by[k]["exact_match"]} for k in LEVELS[:-1] if k in by}


def score_table(scores: list[dict], metric: str = "exact_match") -> str:
    """Level scores as text columns."""
    by = {s["hardness"]: s for s in scores}
    shown = [k for k in LEVELS if k in by]
    rows = [("", *shown), ("count", *(str(by[k]["count"]) for k in shown)), (metric, *(f"{by[k][metric]:.3f}" for k in shown))]
    return "\n".join("".join(f"{c:<14}" for c in r).rstrip() for r in rows)


def delta_text(rows: list[dict]) -> str:
    fmt = lambda v, f: "n/a" if v is None else format(v, f)
    head = f"{'model':>8}  {'N':>5}  {'EM':>8}  {'EX':>8}  {'dEM':>8}  {'dEX':>8}"
    return "\n".join([head, *(f"{r['model']:>8}  {r['n']:>5}  {fmt(r['em'], '.4f'):>8}  {fmt(r['ex'], '.4f'):>8}  {fmt(r['d_em'], '+.4f'):>8}  {fmt(r['d_ex'], '+.4f'):>8}" for r in rows)])
