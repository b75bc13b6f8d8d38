"""Noun-to-schema matching by cosine similarity, and what becomes of the hints."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querent.operators.schema import priority
from querent.sources.files import stored

#: Text prefixes of the default family of encoders, and the hint limit.
QUERY_PREFIX, DOCUMENT_PREFIX, MAX_HINTS = "query: ", "passage: ", 3

HINT = "struct<vi_noun: string, table: string, column: string, similarity: double, table_type: string>"


def takes_prefix(model: str) -> bool:
    return "embeddinggemma" not in model.lower()


def query_prefix(model: str) -> str:
    return QUERY_PREFIX if takes_prefix(model) else ""


def document_prefix(model: str) -> str:
    return DOCUMENT_PREFIX if takes_prefix(model) else ""


# -- encoding

_encoders: dict[str, Callable] = {}


def encoder_of(model: str, load: Callable[[str], Callable]) -> Callable:
    """The worker's encoder of that name, loaded once."""
    if model not in _encoders:
        _encoders[model] = load(model)
    return _encoders[model]


def forget_encoder(model: str) -> None:
    _encoders.pop(model, None)
    gc.collect()


def _encode(batches: Iterator[pa.RecordBatch], model: str, load: Callable[[str], Callable], prefix: str, size: int, kind: str) -> Iterator[pa.RecordBatch]:
    encode = encoder_of(model, load)
    if own := getattr(encode, f"encode_{kind}", None):
        encode, prefix = own, ""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            texts = batch.column(0).slice(at, size)
            vectors = np.asarray(encode([prefix + t for t in texts.to_pylist()]), np.float32)
            norm = np.linalg.norm(vectors, axis=1, keepdims=True)
            vectors = vectors / np.where(norm > 0, norm, 1)
            yield pa.RecordBatch.from_arrays([texts, pa.array(list(vectors), pa.list_(pa.float32()))], ["text", "embedding"])


def encode_texts(texts: DataFrame, model: str, load: Callable[[str], Callable], prefix: str = "", batch_size: int = 128, kind: str = "query") -> DataFrame:
    """(text, embedding) of the different texts of a column ``text``, unit length.

    ``load(model)`` runs on the workers and gives a function from a list of
    texts to a matrix, or an object whose methods ``encode_query`` and
    ``encode_document`` are such functions; then ``kind`` picks one, and no
    prefix is put before the texts.  Texts are made distinct first: the encoder
    is the cost.
    """
    once = texts.select("text").filter("text IS NOT NULL").distinct()
    return once.mapInArrow(partial(_encode, model=model, load=load, prefix=prefix, size=batch_size, kind=kind), "text string, embedding array<float>")


# -- matching


class TargetBlock:
    """The targets of one part, by falling bound on what they can score: the longest weighted vectors first."""

    def __init__(self, rows: pa.RecordBatch, width: int, chunk: int = 256):
        self.idx, weight = (rows.column(i).to_numpy() for i in (4, 5))
        vectors = matrix_of(rows.column(6), width)
        bound = np.sqrt((vectors**2).sum(axis=1)) * np.abs(weight)
        order = np.lexsort((self.idx, -bound))
        self.idx, self.weight, self.vectors, self.chunk = self.idx[order], weight[order], vectors[order], chunk
        self.bound, self.chunks_seen = bound[order], 0

    def best(self, nouns: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(target_idx, score) of each noun's best target; below the threshold -1, as no more is asked.

        Chunks go on only for nouns that the next one could still reach.  Scores
        that a matrix product leaves within rounding of the best are summed
        again, each in the same order, so that equal targets tie and the first wins.
        """
        length = np.sqrt((nouns**2).sum(axis=1))
        top, at = np.full(len(nouns), threshold), np.full(len(nouns), -1, np.int64)
        for start in range(0, len(self.idx), self.chunk):
            live = np.flatnonzero(length * self.bound[start] * (1 + 1e-9) + 1e-12 >= top)
            if not len(live):
                break
            self.chunks_seen += 1
            part = slice(start, start + self.chunk)
            product = nouns[live] @ self.vectors[part].T * self.weight[part]
            near = product >= (np.maximum(product.max(axis=1), top[live]) - 1e-9 * (1 + length[live]))[:, None]
            row, col = np.nonzero(near)
            exact, idx = (nouns[live][row] * self.vectors[part][col]).sum(axis=1) * self.weight[part][col], self.idx[part][col]
            order = np.lexsort((idx, -exact, row))
            first = order[np.unique(row[order], return_index=True)[1]]
            own, score, found = live[row[first]], exact[first], idx[first]
            better = (score > top[own]) | (score == top[own]) & ((at[own] < 0) | (found < at[own]))
            top[own[better]], at[own[better]] = score[better], found[better]
        return at, top


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """A list column of vectors of one length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * width or (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError(f"vectors of other lengths than {width}")
    return flat.reshape(len(column), width)


def _top_one(batches: Iterator[pa.RecordBatch], threshold: float, keys: int) -> Iterator[pa.RecordBatch]:
    """Parts in order, the targets (kind 0) of each before its nouns (kind 1): (keys..., target_idx, s) of nouns that reach the threshold.

    Columns: db_id, block, slice, kind, target_idx, weight, embedding, keys.
    """
    now, held, block = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        cuts = [0, *(i for i in range(1, len(part)) if part[i] != part[i - 1]), len(part)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if part[start][:3] != now:
                now, held, block = part[start][:3], [], None
            if part[start][3] == 0:
                held.append(batch.slice(start, end - start))
                continue
            if not held:
                continue
            if block is None:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                block = TargetBlock(rows, len(rows.column(6)[0]))
            for at in range(start, end, 4096):
                nouns = batch.slice(at, min(4096, end - at))
                idx, s = block.best(matrix_of(nouns.column(6), block.vectors.shape[1]), threshold)
                hit = pa.array(np.flatnonzero(idx >= 0))
                yield pa.RecordBatch.from_arrays([nouns.column(0).take(hit), *(nouns.column(7 + k).take(hit) for k in range(keys)), pa.array(idx).take(hit), pa.array(s).take(hit)], names=["db_id", *(f"k{k}" for k in range(keys)), "target_idx", "s"])


def top_one(nouns: DataFrame, targets: DataFrame, keys: list[str], threshold: float, block: int = 4096, slice_rows: int = 65_536) -> DataFrame:
    """(db_id, keys..., target_idx, s): for each noun the target of its database with the largest weighted inner product.

    nouns(db_id, keys..., embedding), targets(db_id, target_idx, weight,
    embedding); ``target_idx`` is not negative and tells the targets of a
    database apart, ties go to the smallest.  Only products of ``threshold`` or
    more are given.  Targets of a database are cut into blocks and its nouns
    into slices, so neither a large schema nor a database with most of the
    nouns meets in one task; a task multiplies batches of nouns with a block and
    stops where no longer target could change a result.  Targets of a database
    with equal vectors and weights score alike, so only the smallest of them is
    asked.  Nouns and targets without a vector take no part.
    """
    x, t = nouns.filter("embedding IS NOT NULL AND db_id IS NOT NULL"), targets.filter("embedding IS NOT NULL")
    t = t.groupBy("db_id", "weight", "embedding").agg(F.min("target_idx").alias("target_idx"))
    cut = lambda df, most, name: df.groupBy("db_id").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    sizes = cut(x, slice_rows, "slices").join(cut(t, block, "blocks"), "db_id")
    whole = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    none = [F.lit(None).cast(x.schema[k].dataType).alias(f"k{i}") for i, k in enumerate(keys)]
    heads = t.join(sizes, "db_id").withColumn("block", F.pmod(F.xxhash64("target_idx"), "blocks").cast("int")).withColumn("slice", F.explode(whole("slices")))
    heads = heads.select("db_id", "block", "slice", F.lit(0).alias("kind"), F.col("target_idx").cast("long"), F.col("weight").cast("double"), F.col("embedding").cast("array<double>"), *none)
    rows = x.join(sizes, "db_id").withColumn("slice", F.pmod(F.xxhash64(*keys, F.monotonically_increasing_id()), "slices").cast("int")).withColumn("block", F.explode(whole("blocks")))
    rows = rows.select("db_id", "block", "slice", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("target_idx"), F.lit(None).cast("double").alias("weight"), F.col("embedding").cast("array<double>"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))
    both = heads.union(rows).repartition("db_id", "block", "slice").sortWithinPartitions("db_id", "block", "slice", "kind")
    shape = ", ".join(["db_id string", *(f"k{i} {x.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)), "target_idx long", "s double"])
    found = both.withColumn("db_id", F.col("db_id").cast("string")).mapInArrow(partial(_top_one, threshold=threshold, keys=len(keys)), shape)
    best = found.groupBy("db_id", *(f"k{i}" for i in range(len(keys)))).agg(F.max_by(F.struct("target_idx", "s"), F.struct("s", -F.col("target_idx"))).alias("b"))
    return best.select("db_id", *(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), "b.target_idx", "b.s")


def best_tables(nouns: DataFrame, tables: DataFrame, threshold: float = 0.4, block: int = 4096) -> DataFrame:
    """(noun_pos, vi_noun, table, similarity): each noun's nearest table.

    nouns(noun_pos, vi_noun, embedding), tables(target_idx, table, embedding).
    Ties go to the first table.
    """
    one = lambda df, *cols: df.select(F.lit("").alias("db_id"), *cols, "embedding")
    best = top_one(one(nouns, "noun_pos", "vi_noun"), one(tables, "target_idx", F.lit(1.0).alias("weight")), ["noun_pos", "vi_noun"], threshold, block)
    named = tables.select("target_idx", "table")
    return best.join(named, "target_idx").select("noun_pos", "vi_noun", "table", F.round("s", 4).alias("similarity"))


def best_targets(nouns: DataFrame, targets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Each noun's best target by similarity times table priority.

    nouns(example_idx, db_id, noun_pos, vi_noun, embedding) and
    targets(db_id, target_idx, table, column, table_type, embedding).  Ties go
    to the first target; the threshold tests the unrounded value.
    """
    best = _named_best(nouns, targets, ["example_idx", "noun_pos", "vi_noun"], threshold)
    return best.select("example_idx", "noun_pos", "vi_noun", "table", "column", "similarity", "table_type")


def _named_best(nouns: DataFrame, targets: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(db_id, keys..., table, column, similarity, table_type) of each noun's best target."""
    weighted = targets.select("db_id", "target_idx", priority(F.col("table_type")).alias("weight"), "embedding")
    best = top_one(nouns.select("db_id", *keys, "embedding"), weighted, keys, threshold)
    named = targets.select("db_id", "target_idx", "table", "column", "table_type")
    return best.join(named, ["db_id", "target_idx"]).select("db_id", *keys, "table", "column", F.round("s", 4).alias("similarity"), "table_type")


def ranked_matches(matches: DataFrame) -> DataFrame:
    """(example_idx, hints): all matches, the most similar first, ties by noun position."""
    entry = F.struct((-F.col("similarity")).alias("k"), "noun_pos", F.struct("vi_noun", "table", "column", "similarity", "table_type").alias("h"))
    return matches.groupBy("example_idx").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["h"]).alias("hints"))


# -- hints


def limit_hints(hints: DataFrame, most: int = MAX_HINTS) -> DataFrame:
    """The best hint of each target, the most similar first, at most ``most``.

    hints(example_idx, hints array).  Of equal ones the first stays, and equal
    targets keep the order of their first hints.  Rows without hints keep [].
    """
    each = hints.select("example_idx", F.posexplode("hints").alias("pos", "h"))
    best = each.groupBy("example_idx", F.col("h.table").alias("t"), F.coalesce("h.column", F.lit("")).alias("c")).agg(F.min("pos").alias("first"), F.expr("max_by(h, struct(h.similarity, -pos))").alias("h"))
    entry = F.struct((-F.col("h.similarity")).alias("k"), "first", "h")
    top = best.groupBy("example_idx").agg(F.slice(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["h"]), 1, most).alias("top"))
    kind = hints.schema["hints"].dataType
    return hints.select("example_idx").join(top, "example_idx", "left").select("example_idx", F.coalesce("top", F.array().cast(kind)).alias("hints"))


def at_thresholds(hints: DataFrame, thresholds: list[float]) -> DataFrame:
    """The hints of one run at the lowest threshold, cut for each of several.

    One row for each example and threshold, from one scan: a filter on the
    rounded similarity in the array.
    """
    levels = F.array(*(F.lit(float(t)) for t in sorted(set(thresholds))))
    each = hints.withColumn("threshold", F.explode(levels))
    return each.withColumn("hints", F.filter("hints", lambda h: h["similarity"] >= F.col("threshold")))


def augment(examples: DataFrame, names: DataFrame, targets: DataFrame, encode_nouns: Callable[[DataFrame], DataFrame], threshold: float = 0.4) -> DataFrame:
    """Hints for examples(example_idx, db_id, tagged array<struct<token, tag>>).

    names(db_id, names), targets with embeddings; ``encode_nouns`` maps distinct
    texts to (text, embedding).  Returns example_idx, db_id, raw, candidates, hints.
    Nouns are rows, found in one pass over the tokens; those that stay are
    encoded and matched once for each text and database, then joined by text.
    Vectors, of targets too, are stored: what asks for them more than once does
    not run the encoder again.
    """
    from querent.functions.text import noun_candidates
    from querent.operators.nouns import kept

    raw = F.coalesce(noun_candidates(F.col("tagged")), F.array().cast("array<string>"))
    found = examples.select("example_idx", "db_id", F.posexplode(raw).alias("noun_pos", "noun"))
    nouns = stored(kept(found, names.select("db_id", F.explode("names").alias("name"))).withColumnRenamed("noun", "vi_noun"), "nouns")
    once = nouns.select("db_id", "vi_noun").distinct()
    vectors = encode_nouns(once.select(F.col("vi_noun").alias("text")).distinct()).withColumnRenamed("text", "vi_noun")
    best = _named_best(stored(once.join(vectors, "vi_noun"), "vectors"), stored(targets, "targets"), ["vi_noun"], threshold)
    hints = limit_hints(ranked_matches(nouns.join(best, ["db_id", "vi_noun"])))
    own = nouns.groupBy("example_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("noun_pos", "vi_noun"))), lambda x: x["vi_noun"]).alias("candidates"))
    out = examples.select("example_idx", "db_id", raw.alias("raw")).join(own, "example_idx", "left").join(hints, "example_idx", "left")
    return out.select("example_idx", "db_id", "raw", F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"), F.coalesce("hints", F.array().cast(f"array<{HINT}>")).alias("hints"))


def filter_counts(examples: DataFrame) -> DataFrame:
    """(example_idx, reason counters, kept) of examples(example_idx, raw, names)."""
    from querent.functions.text import REASONS, filter_reason, kept_nouns

    reasons = F.transform("raw", lambda x: filter_reason(x, F.col("names")))
    e = examples.withColumn("reasons", reasons).withColumn("kept", kept_nouns(F.col("raw"), F.col("names")))
    count = lambda r: F.size(F.filter("reasons", lambda x: x == r)).alias(r)
    return e.select("example_idx", F.size("raw").alias("total_nouns_before_filter"), *(count(r) for r in REASONS), F.size("kept").alias("nouns_after_filter"), "kept", "raw", "reasons")


def filter_totals(examples: DataFrame) -> DataFrame:
    """One row of the totals of ``filter_counts`` over examples(example_idx, raw, names).

    Nouns are counted by text and list of names, and each different one is judged
    once, in a row of its own.  A reason is that of the stripped noun; an example
    counts each noun that stays once.
    """
    from querent.functions.text import REASONS, filter_reason, strip

    said = examples.select("names", F.transform("raw", strip).alias("raw"))
    every = said.select("names", F.explode("raw").alias("noun")).groupBy("names", "noun").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("own"))
    own = said.select("names", F.explode(F.array_distinct("raw")).alias("noun")).groupBy("names", "noun").agg(F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("own"))
    each = every.union(own).groupBy("names", "noun").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
    judged = each.withColumn("reason", filter_reason(F.col("noun"), F.col("names")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    by = [total(F.when(F.col("reason") == r, F.col("n"))).alias(r) for r in REASONS]
    return judged.agg(total("n").alias("total_nouns_before_filter"), *by, total(F.when((F.col("reason") == "") & (F.col("noun") != ""), F.col("own"))).alias("nouns_after_filter"))


def top_removed_stopwords(counted: DataFrame, per_example: int = 10, most: int = 10) -> DataFrame:
    """(term, n): each example gives its ``per_example`` commonest removed stop-words."""
    each = counted.select("example_idx", F.posexplode(F.arrays_zip("raw", "reasons")).alias("pos", "x")).filter("x.reasons = 'vietnamese_stopwords_removed'")
    own = each.groupBy("example_idx", F.trim(F.lower("x.raw")).alias("term")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("example_idx").orderBy(F.desc("n"), "pos"))
    kept = own.withColumn("r", rank).filter(F.col("r") <= per_example)
    total = kept.groupBy("term").agg(F.sum("n").alias("n"), F.min(F.struct("example_idx", "r")).alias("first"))
    return total.orderBy(F.desc("n"), "first").limit(most).select("term", "n")
