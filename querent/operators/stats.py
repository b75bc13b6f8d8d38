"""Coverage statistics of hints: counts, histogram, unmatched nouns, distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edges of the similarity histogram, and the counters of the noun filter.
BINS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 0.8, 0.9, 1.0)
FILTER_KEYS = ("total_nouns_before_filter", "english_nouns_removed", "vietnamese_stopwords_removed", "schema_name_duplicates_removed", "too_short_removed", "too_long_removed", "nouns_after_filter")
TABLE_TYPES = ("entity", "reference", "junction")


def _count_columns(n: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_examples"),
        F.count_if(n > 0).alias("examples_with_hints"),
        F.count_if(n <= 0).alias("examples_without_hints"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_hints_per_example"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_hints_in_one_example"),
    ]


def hint_counts(hints: DataFrame) -> DataFrame:
    """One row: totals, and mean and largest number of hints an example."""
    return hints.agg(*_count_columns(F.size("hints")))


def _bin(v: Column, bins: tuple[float, ...]) -> Column:
    """The half-open bin of a value, the last one closed; null outside the edges."""
    place = F
    for i, (lo, hi) in enumerate(zip(bins, bins[1:], strict=False)):
        place = place.when((v >= lo) & ((v <= hi) if i == len(bins) - 2 else (v < hi)), i)
    return place  # type: ignore[return-value]


def histogram(values: DataFrame, column: str, bins: tuple[float, ...] = BINS) -> DataFrame:
    """(bin, lower, upper, n): half-open bins, the last one closed; empty bins count 0.

    Values outside the edges are in no bin.
    """
    counts = values.select(_bin(F.col(column), bins).alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    edges = values.sparkSession.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(zip(bins, bins[1:], strict=False))], "bin int, lower double, upper double")
    return edges.join(counts, "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"))


def similarities(hints: DataFrame) -> DataFrame:
    return hints.select(F.explode("hints.similarity").alias("similarity"))


def unmatched_nouns(hints: DataFrame, most: int = 10) -> DataFrame:
    """(noun, occurrences) of candidates without a hint; ties by first appearance.

    A noun whose hint was cut by the limit counts as unmatched.
    """
    each = hints.select("example_idx", F.posexplode("candidates").alias("pos", "noun"), F.col("hints.vi_noun").alias("matched")).filter(~F.array_contains("matched", F.col("noun")))
    by = each.groupBy("noun").agg(F.count(F.lit(1)).alias("occurrences"), F.min(F.struct("example_idx", "pos")).alias("first"))
    return by.orderBy(F.desc("occurrences"), "first").limit(most).select("noun", "occurrences")


def table_type_distribution(hints: DataFrame) -> DataFrame:
    """(table_type, n): the three known types always, then others that occur."""
    found = hints.select(F.explode("hints.table_type").alias("table_type")).groupBy(F.coalesce("table_type", F.lit("unknown")).alias("table_type")).agg(F.count(F.lit(1)).alias("n"))
    fixed = hints.sparkSession.createDataFrame([(t, 0) for t in TABLE_TYPES], "table_type string, n long")
    return found.union(fixed).groupBy("table_type").agg(F.sum("n").alias("n"))


def match_levels(hints: DataFrame) -> DataFrame:
    """One row: hints on tables, hints on columns."""
    h = hints.select(F.explode("hints.column").alias("column"))
    named = F.coalesce(F.col("column"), F.lit("")) != ""
    return h.agg(F.count_if(~named).alias("table_level"), F.count_if(named).alias("column_level"))


def filter_stats(counted: DataFrame | None, hints: DataFrame) -> DataFrame:
    """One row of counters; without a filter run, all candidates count as kept."""
    if counted is None:
        total = F.coalesce(F.sum(F.size("candidates")), F.lit(0))
        return hints.agg(*((total if k in (FILTER_KEYS[0], FILTER_KEYS[-1]) else F.lit(0).cast("long")).alias(k) for k in FILTER_KEYS))
    return counted.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in FILTER_KEYS))


def augment_stats(hints: DataFrame, model: str, threshold: float, counted: DataFrame | None = None, stopwords: DataFrame | None = None) -> DataFrame:
    """One row with everything, nested as the statistics file has it.

    Each part is an aggregate of one row, so the joins are between single rows.
    """
    rows = lambda df, *cols: df.agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("x"))
    one = lambda df, name: df.select(F.struct("*").alias(name))
    bins = rows(histogram(similarities(hints), "similarity"), "bin", "n").select(F.struct(F.array(*map(F.lit, BINS)).alias("bins"), F.col("x.n").alias("counts")).alias("similarity_distribution"))
    top = unmatched_nouns(hints).withColumn("k", -F.col("occurrences"))
    top = rows(top, "k", "noun", "occurrences").select(F.transform("x", lambda e: F.struct(e["noun"].alias("noun"), e["occurrences"].alias("occurrences"))).alias("top_unmatched_nouns"))
    types = table_type_distribution(hints).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table_type", "n")))).alias("table_type_distribution"))
    kept = filter_stats(counted, hints)
    none = hints.sparkSession.createDataFrame([], "term string, n long") if stopwords is None else stopwords
    terms = none.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "n")))).alias("top_removed_stopwords"))
    config = F.struct(F.lit(model).alias("model"), F.lit(float(threshold)).alias("threshold")).alias("config")
    out = one(hint_counts(hints), "counts").select(config, "counts")
    for part in (bins, top, one(kept.crossJoin(terms), "filter_stats"), types, one(match_levels(hints), "match_level")):
        out = out.crossJoin(part)
    return out


def records_at(hints: DataFrame, model: str, thresholds: list[float], counted: DataFrame | None = None, stopwords: DataFrame | None = None, most: int = 10) -> DataFrame:
    """One row of ``augment_stats`` for each threshold, from one pass over the hints of the lowest.

    A hint's level is how many thresholds its similarity reaches.  Everything is
    counted once by level; sums over the levels from a threshold on are its
    record, and sums below it are its unmatched nouns.  ``hints`` are as
    ``augment_stats`` takes them.
    """
    spark, levels = hints.sparkSession, sorted({float(t) for t in thresholds})
    steps = spark.createDataFrame([(i, t) for i, t in enumerate(levels, 1)], "i int, threshold double")
    level = lambda s: reduce(lambda a, b: a + b, (F.when(s >= t, 1).otherwise(0) for t in levels))

    reach = lambda t: lambda h: h["similarity"] >= t
    sizes = F.array(*(F.size(F.filter("hints", reach(t))) for t in levels))
    counts = hints.select(F.posexplode(sizes).alias("p", "n")).groupBy((F.col("p") + 1).alias("i")).agg(*_count_columns(F.col("n")))
    counts = steps.join(counts, "i", "left").select("i", F.struct(*(F.coalesce(c, F.lit(0)).alias(c) for c in ("total_examples", "examples_with_hints", "examples_without_hints", "avg_hints_per_example", "max_hints_in_one_example"))).alias("counts"))

    each = hints.select(F.explode("hints").alias("h"))
    facts = each.select(level(F.col("h.similarity")).alias("level"), _bin(F.col("h.similarity"), BINS).alias("bin"), F.coalesce("h.table_type", F.lit("unknown")).alias("kind"), (F.coalesce("h.column", F.lit("")) != "").alias("named"))
    facts = facts.groupBy("level", "bin", "kind", "named").agg(F.count(F.lit(1)).alias("n"))
    at = steps.join(facts, F.col("level") >= F.col("i"), "left")
    in_bin = [F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("n"))), F.lit(0)) for b in range(len(BINS) - 1)]
    sums = at.groupBy("i").agg(F.struct(F.array(*map(F.lit, BINS)).alias("bins"), F.array(*in_bin).alias("counts")).alias("similarity_distribution"), F.struct(*(F.coalesce(F.sum(F.when(F.col("named") == named, F.col("n"))), F.lit(0)).alias(name) for name, named in (("table_level", False), ("column_level", True)))).alias("match_level"))
    kinds = at.filter("kind IS NOT NULL").select("i", "kind", "n").union(steps.select("i", F.explode(F.array(*map(F.lit, TABLE_TYPES))), F.lit(0).cast("long"))).groupBy("i", "kind").agg(F.sum("n").alias("n"))
    kinds = kinds.groupBy("i").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("table_type_distribution"))

    nouns = hints.select("example_idx", F.posexplode("candidates").alias("pos", "noun"), F.col("hints").alias("own"))
    reached = F.coalesce(F.array_max(F.transform(F.filter("own", lambda h: h["vi_noun"] == F.col("noun")), lambda h: h["similarity"])), F.lit(float("-inf")))
    by = nouns.select("example_idx", "pos", "noun", level(reached).alias("level")).groupBy("noun", "level").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("example_idx", "pos")).alias("first"))
    lost = steps.join(by, F.col("level") < F.col("i")).groupBy("i", "noun").agg(F.sum("n").alias("occurrences"), F.min("first").alias("first"))
    lost = lost.withColumn("r", F.expr("row_number() OVER (PARTITION BY i ORDER BY occurrences DESC, first)")).filter(F.col("r") <= most)
    lost = lost.groupBy("i").agg(F.array_sort(F.collect_list(F.struct((-F.col("occurrences")).alias("k"), "noun", "occurrences"))).alias("x")).select("i", F.transform("x", lambda e: F.struct(e["noun"].alias("noun"), e["occurrences"].alias("occurrences"))).alias("top_unmatched_nouns"))

    none = spark.createDataFrame([], "term string, n long") if stopwords is None else stopwords
    terms = none.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "n")))).alias("top_removed_stopwords"))
    kept = filter_stats(counted, hints).crossJoin(terms).select(F.struct("*").alias("filter_stats"))
    out = steps.join(counts, "i").join(sums, "i").join(kinds, "i").join(lost, "i", "left").crossJoin(kept)
    empty = F.array().cast("array<struct<noun: string, occurrences: bigint>>")
    return out.select(F.struct(F.lit(model).alias("model"), "threshold").alias("config"), "counts", "similarity_distribution", F.coalesce("top_unmatched_nouns", empty).alias("top_unmatched_nouns"), "filter_stats", "table_type_distribution", "match_level")
