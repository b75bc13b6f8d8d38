"""Digests of many statements that each take the rows of a table between bounds.

A join of statements with the rows between their bounds grows with the result,
that is with statements times rows.  What is wanted of a result is a count, sums
and extremes, so rows of equal values are added up first.  One condition with a
single bound is answered from running sums in the order of its column.  Of each
other one the column's values are numbered; a row is added to the blocks of 1, 2,
4, ... numbers that hold its own, and a statement takes the blocks that make up
its span, at most two of a length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querent.plans.ir import COMPARISONS, Condition
from querent.plans.templates import Param
from querent.sources.files import stored

#: What is known of rows: their number, sums of both hashes, and the extremes of the first.
SUMS = {"n": F.sum, "a": F.sum, "b": F.sum, "low": F.min, "high": F.max}
#: The places of probes among values that are equal to theirs.
BEFORE, VALUE, AFTER = 0, 1, 2


def summed(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*(f(c).alias(c) for c, f in SUMS.items()))


def _nothing(df: DataFrame, names) -> list[Column]:
    return [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]


def running(values: DataFrame, probes: DataFrame, keys: list[str], extra: list[str], down: bool = False) -> DataFrame:
    """Probes (keys, v, tie, extra) with the sums of those values (keys, v, sums) that come before them in the order of v.

    Sums run within the tasks of a sort by keys and v, and begin with those of
    the key's earlier tasks, so no key is one task's work.
    """
    both = values.select(*keys, "v", F.lit(VALUE).alias("tie"), *_nothing(probes, extra), *SUMS).unionByName(probes.select(*keys, "v", "tie", *extra, *_nothing(values, SUMS)))
    v = F.col("v").desc() if down else F.col("v").asc()
    dealt = stored(both.repartitionByRange(*keys, v, F.col("tie").asc()).withColumn("part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*keys, "part").orderBy(v, "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    seen = dealt.select(*keys, "v", "tie", *extra, "part", *(f(c).over(own).alias(c) for c, f in SUMS.items())).filter(F.col("tie") != VALUE)
    starts = summed(dealt, *keys, "part").select(*keys, "part", *(f(c).over(earlier).alias(f"_{c}") for c, f in SUMS.items()))
    added = [(F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).cast(values.schema[c].dataType).alias(c) for c in ("n", "a", "b")]
    return seen.join(starts, [*keys, "part"]).select(*keys, "v", "tie", *extra, *added, F.least("low", "_low").alias("low"), F.greatest("high", "_high").alias("high"))


def _spans(rows: DataFrame, stmts: DataFrame, i: int, low: tuple[str, int] | None, high: tuple[str, int] | None) -> tuple[DataFrame, DataFrame]:
    """Rows and statements with the blocks of v{i} that hold a row and make up a statement's span: equal ``block{i}`` (a length and a number) meet.

    ``low`` and ``high`` are the column of a bound and where it stands among equal values; None is without a bound.
    """
    bounds = [b for b in (low, high) if b]
    values = rows.select(F.col(f"v{i}").alias("v")).distinct()
    ones = values.select("v", F.lit(1).cast("long").alias("n"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("a", "b", "low", "high")))
    asked = values.select("v", F.lit(BEFORE).alias("tie"))
    for name, tie in bounds:
        asked = asked.union(stmts.select(F.col(name), F.lit(tie)))
    places = stored(running(ones, asked.distinct(), [], []).select("v", "tie", F.col("n").alias("place")), "places")
    levels = values.count().bit_length() + 1

    def placed(df: DataFrame, name: str, tie: int, out: str) -> DataFrame:
        own = places.filter(F.col("tie") == tie).select(F.col("v").alias("_v"), F.col("place").alias(out))
        return df.join(own, F.col(name) == F.col("_v")).drop("_v")

    for b, out in ((low, "_from"), (high, "_to")):
        stmts = placed(stmts, *b, out) if b else stmts.withColumn(out, F.lit(0 if out == "_from" else 1 << levels).cast("long"))
    # Of the blocks of a length, a span is from the first that begins in it to the last that ends in it; an odd one at its ends is no half of a longer one.
    ends = f"transform(sequence(0, {levels}), j -> named_struct('j', j, 'l', shiftright(_from + shiftleft(1L, j) - 1, j), 'r', shiftright(_to, j)))"
    taken = f"flatten(transform(filter({ends}, x -> x.l < x.r), x -> filter(array(IF(x.l % 2 = 1, named_struct('j', x.j, 'at', x.l), NULL), IF(x.r % 2 = 1, named_struct('j', x.j, 'at', x.r - 1), NULL)), y -> y IS NOT NULL)))"
    stmts = stored(stmts.withColumn(f"block{i}", F.explode(F.expr(taken))).drop("_from", "_to"), "spans")
    lengths = sorted(r.j for r in stmts.select(f"block{i}.j").distinct().collect())
    blocks = F.array(*(F.struct(F.lit(j).alias("j"), F.shiftright("_place", j).alias("at")) for j in lengths)) if lengths else F.expr("CAST(array() AS array<struct<j: int, at: bigint>>)")
    return placed(rows, f"v{i}", BEFORE, "_place").withColumn(f"block{i}", F.explode(blocks)).drop("_place"), stmts


def range_digests(spark: SparkSession, rows: DataFrame, stmts: DataFrame, conds: list[Condition]) -> DataFrame:
    """(stmt, n, a, b, same) of statements (stmt, p0, ...) over rows (ha, hb, v0, ...): those whose v of each condition meets it.

    Statements without a row are left out.
    """
    bounds = {i: (COMPARISONS[c.op], [p.index for p in (c.low, c.high) if isinstance(p, Param)]) for i, c in enumerate(conds)}
    kinds = {i: rows.select(f"v{i}").union(stmts.select(f"p{ps[0]}")).schema[0].dataType for i, (_, ps) in bounds.items()}  # what Spark compares both as
    for i, (_, ps) in bounds.items():
        for p in ps[1:]:
            kinds[i] = spark.createDataFrame([], T.StructType([T.StructField("v", kinds[i])])).union(stmts.select(f"p{p}")).schema[0].dataType
    rows = rows.select("ha", "hb", *(F.col(f"v{i}").cast(t).alias(f"v{i}") for i, t in kinds.items())).filter(" AND ".join(f"v{i} IS NOT NULL" for i in kinds))  # dropna takes NaN too
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    rows = rows.groupBy(*(f"v{i}" for i in kinds)).agg(F.count(F.lit(1)).alias("n"), wide("ha").alias("a"), wide("hb").alias("b"), F.min("ha").alias("low"), F.max("ha").alias("high"))
    rows = stored(rows, "values")
    used = {f"b{i}_{k}": F.col(f"p{p}").cast(kinds[i]) for i, (_, ps) in bounds.items() for k, p in enumerate(ps)}
    stmts = stmts.select("stmt", *(c.alias(name) for name, c in used.items())).filter(" AND ".join(f"{name} IS NOT NULL" for name in used))
    keys, single = [], next((i for i, (op, _) in bounds.items() if op in (">", ">=", "<", "<=")), None)
    for i, (op, _) in bounds.items():
        if op == "=":
            stmts = stmts.withColumnRenamed(f"b{i}_0", f"v{i}")
            keys.append(f"v{i}")
        elif i != single:
            low = (f"b{i}_0", AFTER if op == ">" else BEFORE) if op in ("between", ">", ">=") else None
            high = (f"b{i}_1", AFTER) if op == "between" else (f"b{i}_0", BEFORE if op == "<" else AFTER) if op in ("<", "<=") else None
            rows, stmts = _spans(rows, stmts, i, low, high)
            keys.append(f"block{i}")
    if single is None:
        met = stmts.select("stmt", *keys).join(summed(rows, *keys), keys)
    else:
        op = bounds[single][0]
        values = summed(rows.withColumnRenamed(f"v{single}", "v"), *keys, "v")
        probes = stmts.select(*keys, F.col(f"b{single}_0").alias("v"), F.lit(BEFORE if op in (">", "<") else AFTER).alias("tie"), "stmt")
        met = running(values, probes, keys, ["stmt"], down=op in (">", ">=")).filter("n > 0")
    return summed(met, "stmt").select("stmt", "n", "a", "b", (F.col("low") == F.col("high")).alias("same"))
