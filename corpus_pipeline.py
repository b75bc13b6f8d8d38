"""The corpus pipeline: STAGES applied to documents, each written and read again.

Each stage works on all rows its predecessor kept.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import line_dedup, mixing, ngram_join, packing, quality
from querent.llm.common import materialize, table

#: Rows of a batch on its way to Python and back.  Texts are long, and buffers of the default 10,000 stand beside a full heap.
BATCH_ROWS = 2_000

#: The score below which a document is rejected, and the limit on a source's passes.
LEAST_QUALITY, MAX_REPEATS = 0.3, 1.5


def _in_small_batches(spark: SparkSession) -> None:
    """Lower the session's batch size to ``BATCH_ROWS`` where it is larger; results do not depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, learned from labelled rows among them."""
    _in_small_batches(spark)
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.accept(docs, model, LEAST_QUALITY)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but the first; a document of nothing else goes too."""
    lines = line_dedup.drop_recurring_lines(docs).filter("n_lines_dropped = 0 OR length(trim(text)) > 0")
    length = F.when(F.col("n_lines_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return lines.withColumn("n_chars", length).select(*docs.columns)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    _in_small_batches(spark)
    return ngram_join.keep_representatives(docs, k=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; small sources more, up to the limit."""
    return mixing.mix(docs, max_repeats=MAX_REPEATS).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in windows of 2048 tokens."""
    _in_small_batches(spark)
    return packing.pack(docs, capacity=2048)


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_near_duplicates),
    ("mixing sources", mix_sources),
    ("packing", pack_windows),
]

#: Training and packing have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
