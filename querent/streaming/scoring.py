"""Structural scores as predictions arrive: the batch operator on a stream.

Scoring keeps no state, so the same code runs in each micro-batch; only the
level counts are kept, as a streaming aggregate of at most five keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.operators.exact import Databases, score_pairs


def score_stream(pairs: DataFrame, dbs: Databases) -> DataFrame:
    """Details of a stream of (id, db_id, gold_sql, pred_sql); append mode."""
    return score_pairs(pairs, dbs)


def level_counts(details: DataFrame) -> DataFrame:
    """(hardness, count, matches) so far; complete or update mode."""
    return details.groupBy("hardness").agg(F.count(F.lit(1)).alias("count"), F.sum(F.col("exact_match").cast("long")).alias("matches"))
