"""Mixing sources to target weights by temperature.

Source shares of tokens are raised to an exponent in [0, 1] and normalised.  The
exponent is found by bisection: the largest that gives the target entropy, then
raised as far as the repetition limit asks.  Weights become token budgets, and
budgets become passes over each source: whole passes, and a last one over part
of a permutation of its blocks that ends at the budget.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.llm.common import materialize


@dataclass(frozen=True)
class Mix:
    exponent: float
    weights: np.ndarray
    budget: float


def weights_for(tokens: np.ndarray, exponent: float) -> np.ndarray:
    share = np.where(tokens > 0, tokens / max(1, tokens.sum()), 0.0)
    w = np.where(share > 0, share**exponent, 0.0)
    return w / w.sum() if w.sum() else w


def entropy(w: np.ndarray) -> float:
    w = w[w > 0]
    return float(-(w * np.log(w)).sum())


def _bisect(good, steps: int = 60) -> float:
    """The end of [0, 1] nearest to where ``good`` begins to hold; it is monotone."""
    low, high = 0.0, 1.0
    if good(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if good(mid) else (mid, high)
    return high


def solve(tokens: np.ndarray, entropy_share: float = 1.0, max_repeats: float = 4.0, budget: float | None = None) -> Mix:
    """Weights with the target entropy (a share of the log of the source count).

    Higher exponents have less entropy and fewer repeats.  Without ``budget``
    the mix is as large as makes every source pass at least once.
    """
    tokens = tokens.astype(np.float64)
    if not (tokens > 0).any():
        return Mix(1.0, np.zeros(len(tokens)), 0.0)

    def size(w: np.ndarray) -> float:
        return budget if budget is not None else float((tokens[w > 0] / w[w > 0]).max())

    def repeats(a: float) -> float:
        w = weights_for(tokens, a)
        return float((size(w) * w[w > 0] / tokens[w > 0]).max())

    target = entropy_share * np.log(max(1, (tokens > 0).sum()))
    exponent = _bisect(lambda a: entropy(weights_for(tokens, a)) <= target + 1e-12)
    if repeats(exponent) > max_repeats * (1 + 1e-9):
        exponent = max(exponent, _bisect(lambda a: repeats(a) <= max_repeats * (1 + 1e-9)))
    w = weights_for(tokens, exponent)
    return Mix(exponent, w, size(w))


def mix(docs: DataFrame, entropy_share: float = 1.0, max_repeats: float = 4.0, budget: float | None = None, seed: int = 17, block_rows: int = 2000, most_sources: int = 100_000, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """The documents, each as often as the mix draws it.

    ``tokens`` is a row's token count (default: UTF-8 bytes over four, rounded
    up, at least 1; null texts count 1).  Null sources are one source.  Source
    totals go to the driver, at most ``most_sources`` of them; more is an error.

    All columns stay; added (or replaced): mix_pass (from 0), mix_tokens,
    mix_order (a permutation of the output).  Rows that repeat are drawn each
    (with equal order).  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    count = tokens if tokens is not None else F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) / 4))
    names = [c for c in docs.columns if c.lower() not in ("mix_pass", "mix_tokens", "mix_order")]
    source = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("-"))
    #: The columns travel as one struct, so none of them can clash with a helper column.
    key = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"), count.cast("long").alias("mix_tokens"), source.alias("_source"), key.alias("_key"))
    totals = rows.groupBy("_source").agg(F.sum("mix_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).orderBy("_source").limit(most_sources + 1).collect()
    if len(totals) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    have = np.array([t["tokens"] for t in totals], np.int64)
    m = solve(have, entropy_share, max_repeats, budget)
    plan = []
    for t, w in zip(totals, m.weights.tolist(), strict=True):
        passes = m.budget * w / t["tokens"]
        whole = int(np.floor(passes + 1e-9))
        plan.append((t["_source"], whole, int(round((passes - whole) * t["tokens"])) if passes > whole + 1e-9 else 0, max(1, -(-t["rows"] // block_rows))))
    per = F.broadcast(spark.createDataFrame(plan, "_source string, _whole int, _part long, _blocks long"))
    rows = rows.join(per, "_source").withColumn("_block", F.expr("pmod(_key, _blocks)"))

    #: The last pass: blocks in hashed order until the budget; the block it ends in is cut in hashed order.
    blocks = rows.filter("_part > 0").groupBy("_source", "_block", "_part").agg(F.sum("mix_tokens").alias("size"))
    blocks = blocks.withColumn("_place", F.xxhash64(F.lit(seed + 1), "_source", "_block"))
    before = F.sum("size").over(Window.partitionBy("_source").orderBy("_place", "_block")) - F.col("size")
    blocks = materialize(blocks.withColumn("before", before).filter("before < _part").select("_source", "_block", "before", F.expr("before + size <= _part").alias("all")), "blocks")
    full = blocks.filter("all").select("_source", "_block")
    ends = blocks.filter("NOT all").select("_source", "_block", "before")
    extra = rows.join(full, ["_source", "_block"], "left_semi")
    running = F.sum("mix_tokens").over(Window.partitionBy("_source", "_block").orderBy(F.xxhash64(F.lit(seed + 2), "_key"), F.col("doc")[id_col]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = rows.join(ends, ["_source", "_block"]).withColumn("_end", F.col("before") + running).filter("_end <= _part").drop("before", "_end")
    passes = rows.withColumn("mix_pass", F.explode(F.expr("IF(_whole > 0, sequence(0, _whole - 1), CAST(array() AS array<int>))")))
    cut = extra.select(*rows.columns).union(last.select(*rows.columns)).withColumn("mix_pass", F.col("_whole"))
    out = passes.union(cut.select(*passes.columns))
    order = F.xxhash64(F.lit(seed + 3), "mix_pass", "_key")
    return out.select("doc.*", "mix_pass", "mix_tokens", order.alias("mix_order"))
