"""Hard-negative mining: a Voronoi-partitioned, exact inner-product join of anchors with all rows.

Vectors get one more component, sqrt(M**2 - norm**2) for rows and 0 for
anchors, so that the largest inner product is the smallest distance.  Pivots
cut that space into cells.  What is known of a cell, its anchors' largest
distance to the pivot and bounds on the distances they look for, tells by the
triangle inequality which groups of anchors a row might serve; it goes to
those only.  Groups are joined in slices of rows that stream past the anchors
of one task, which keep the best few of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.llm.common import lean, materialize

#: A row (vec_id, label, row, vector); ``row`` tells rows of one vec_id apart.
_ROWS_DDL = "vec_id long, label long, row long, vector array<double>"
_LONG = np.iinfo(np.int64)


# --- vectors ---------------------------------------------------------------


def dense(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix; shorter vectors count as filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows; beyond 64 bits they count as the nearest long."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    ints = [np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (a, b)]
    out = np.array([[sum(x * y for x, y in zip(p, q, strict=True)) for q in ints[1]] for p in ints[0]], object).reshape(len(a), len(b))
    return np.clip(out, _LONG.min, _LONG.max).astype(np.int64)


def lifted(x: np.ndarray, most: float | None) -> np.ndarray:
    """Vectors with the component that makes all norms ``most``; 0 for anchors (None)."""
    with np.errstate(all="ignore"):
        extra = np.zeros(len(x)) if most is None else np.sqrt(np.maximum(most * most - (x * x).sum(axis=1), 0))
    return np.hstack([x, extra[:, None]])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to pivots; infinite or NaN where squares overflow, which prunes nothing."""
    with np.errstate(all="ignore"):
        return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T, 0))


def nearest(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row and its distance to that pivot, rows without a defined one in cell 0 at infinity."""
    d = np.where(np.isnan(d), np.inf, d)
    cell = d.argmin(axis=1)
    return cell, d[np.arange(len(d)), cell]


# --- tasks -----------------------------------------------------------------


@lean
def _summary(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, most: float, least: int) -> Iterator[pa.RecordBatch]:
    """Of each cell and label in a task, the ``least`` different rows nearest to the pivot."""
    width, kept = pivots.shape[1] - 1, []

    def cut() -> pd.DataFrame:
        near = pd.concat(kept).drop_duplicates(["cell", "label", "vec_id", "row"]).sort_values(["cell", "label", "dist"])
        return near.groupby(["cell", "label"]).head(least)

    for batch in batches:
        cell, dist = nearest(distances(lifted(dense(batch.column(3), width), most), pivots))
        kept = [*kept, pd.DataFrame({"cell": cell, "label": batch.column(1), "vec_id": batch.column(0), "row": batch.column(2), "dist": dist})]
        kept = [cut()]
    if kept:
        yield pa.RecordBatch.from_pandas(kept[0].astype({"cell": "int64"}), preserve_index=False)


@lean
def _assigned(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Anchors with their cell and distance to its pivot."""
    for batch in batches:
        cell, dist = nearest(distances(lifted(dense(batch.column(3), pivots.shape[1] - 1), None), pivots))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64)), pa.array(dist)], names=[*batch.schema.names, "cell", "dist"])


@lean
def _needed(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, most: float, inner: np.ndarray, outer: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows with the groups they might serve: those with a cell whose ring around the pivot they are in."""
    groups = range(int(group.max()) + 1)
    for batch in batches:
        d = distances(lifted(dense(batch.column(3), pivots.shape[1] - 1), most), pivots)
        serves = ~((d > outer) | (d < inner))
        hit = np.stack([serves[:, group == g].any(axis=1) for g in groups], axis=1)
        at, own = np.nonzero(hit)
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns), pa.array(own.astype(np.int64))], names=[*batch.schema.names, "group"])


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` different rows, by falling score and then rising id."""
    order = np.lexsort((rows, ids, -scores.astype(object) if scores.size and scores.min() == _LONG.min else -scores))
    twin = np.zeros(len(order), bool)
    twin[1:] = (ids[order][1:] == ids[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    return order[~twin][:k]


class Shortlist:
    """The best rows of one anchor and window so far."""

    def __init__(self, k: int, low: int = _LONG.min, high: int = _LONG.max):
        self.k, self.low, self.high = k, low, high
        self.scores = self.ids = self.rows = np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        floor = max(self.low, int(self.scores[-1])) if len(self.scores) == self.k else self.low
        on = np.flatnonzero((scores >= floor) & (scores <= self.high))
        if len(on):
            s, i, r = (np.concatenate([a, b[on]]) for a, b in ((self.scores, scores), (self.ids, ids), (self.rows, rows)))
            first = best(s, i, r, self.k)
            self.scores, self.ids, self.rows = s[first], i[first], r[first]


_FOUND = pa.schema([("anchor_id", pa.int64()), ("anchor_row", pa.int64()), ("window", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "anchor_id long, anchor_row long, window long, vec_id long, row long, score long"


class Block:
    """The anchors of one task's part and their shortlists: of equal labels without windows, else of different ones."""

    def __init__(self, k: int, width: int, windows: bool):
        self.k, self.width, self.windows = k, width, windows
        self.anchors: list[pa.RecordBatch] = []
        self.lists: list[list[Shortlist]] | None = None

    def begin(self) -> None:
        rows = pa.Table.from_batches(self.anchors).combine_chunks().to_batches()[0]
        self.ids, self.labels, self.keys = (rows.column(i).to_numpy() for i in (2, 3, 4))
        self.x = dense(rows.column(5), self.width)
        if self.windows:
            self.lists = [[Shortlist(self.k, w["low"], w["high"]) for w in ws] for ws in rows.column(6).to_pylist()]
        else:
            self.lists = [[Shortlist(self.k)] for _ in self.ids]

    def pass_by(self, batch: pa.RecordBatch) -> None:
        if self.lists is None:
            self.begin()
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            ids, labels, keys = (part.column(i).to_numpy() for i in (2, 3, 4))
            scores = products(self.x, dense(part.column(5), self.width))
            for a, lists in enumerate(self.lists):
                on = labels != self.labels[a] if self.windows else (labels == self.labels[a]) & ~((ids == self.ids[a]) & (keys == self.keys[a]))
                own = scores[a][on], ids[on], keys[on]
                for short in lists:
                    short.add(*own)

    def found(self) -> pa.RecordBatch:
        rows = [(i, key, w, n, r, s) for i, key, lists in zip(self.ids.tolist(), self.keys.tolist(), self.lists or [], strict=True) for w, short in enumerate(lists, 1) for n, r, s in zip(short.ids.tolist(), short.rows.tolist(), short.scores.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 6)], schema=_FOUND)


@lean
def _joined(batches: Iterator[pa.RecordBatch], k: int, width: int, windows: bool) -> Iterator[pa.RecordBatch]:
    """Parts in order, anchors (kind 0) before the rows (kind 1) of each: shortlists of every anchor."""
    now, block = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        part, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if part[start] != now:
                if block and block.lists is not None:
                    yield block.found()
                now, block = part[start], Block(k, width, windows)
            if kind[start] == 0:
                block.anchors.append(batch.slice(start, end - start))
            elif block.anchors:
                block.pass_by(batch.slice(start, end - start))
    if block and block.lists is not None:
        yield block.found()


# --- plans -----------------------------------------------------------------


def packed(pivots: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Cells in a walk from pivot to nearest pivot, cut into groups of about ``most`` anchors."""
    left, walk, group = set(range(1, len(pivots))), [0], np.zeros(len(pivots), np.int64)
    apart = distances(pivots, pivots)
    while left:
        walk.append(min(left, key=lambda j: (apart[walk[-1], j], j)))
        left.remove(walk[-1])
    total = number = 0
    for cell in walk:
        if total and total + counts[cell] > most:
            number, total = number + 1, 0
        group[cell], total = number, total + counts[cell]
    return group


class Cells:
    """Pivots, and what is known of the anchors of each cell: a table as long as there are pivots."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, width: int, norm: float, pivots: int, block: int, slices: int):
        self.rows, self.width, self.norm, self.slices = rows, width, norm, slices
        drawn = rows.select("vec_id", "row", "vector").orderBy(F.xxhash64("vec_id", "row"), "vec_id", "row").limit(pivots).collect()
        x = np.zeros((len(drawn), width))
        for i, r in enumerate(drawn):
            x[i, : len(r.vector)] = r.vector
        self.pivots = lifted(x, norm)
        self.anchors = materialize(anchors.mapInArrow(partial(_assigned, pivots=self.pivots), f"{_ROWS_DDL}, cell long, dist double"), "negatives-anchors")
        counts, self.reach = np.zeros(len(x), np.int64), np.zeros(len(x))
        for r in self.anchors.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("reach")).collect():
            counts[r.cell], self.reach[r.cell] = r.n, r.reach
        self.full, self.group = counts > 0, packed(self.pivots, counts, block)
        self.blocks = [max(1, -(-int(counts[self.group == g].sum()) // block)) for g in range(int(self.group.max()) + 1)]

    def within(self, least: int) -> np.ndarray:
        """For each cell, a distance within which every anchor has ``least`` different rows of its label.

        The anchor is ``reach`` from its pivot, that pivot a known way from the
        one of another cell, and the nearest rows of that cell a known way from it.
        """
        near = self.rows.select("vec_id", "label", "row", "vector").mapInArrow(partial(_summary, pivots=self.pivots, most=self.norm, least=least), "cell long, label long, vec_id long, row long, dist double")
        near = near.groupBy("cell", "label", "vec_id", "row").agg(F.min("dist").alias("dist"))
        near = near.withColumn("nth", F.expr("row_number() OVER (PARTITION BY cell, label ORDER BY dist, vec_id, row)")).filter(F.col("nth") <= least)
        apart = distances(self.pivots, self.pivots)
        ways = self.rows.sparkSession.createDataFrame([(i, j, float(apart[i, j])) for i in np.flatnonzero(self.full).tolist() for j in range(len(apart))], "own long, cell long, way double")
        held = self.anchors.groupBy(F.col("cell").alias("own"), "label").agg(F.max("dist").alias("reach"))
        bound = held.join(near, "label").join(F.broadcast(ways), ["own", "cell"]).select("own", "label", (F.col("reach") + F.col("way") + F.col("dist")).alias("bound"))
        bound = bound.withColumn("nth", F.expr("row_number() OVER (PARTITION BY own, label ORDER BY bound)")).filter(F.col("nth") == least)
        bound = held.join(bound.select("own", "label", "bound"), ["own", "label"], "left").groupBy("own").agg(F.max(F.coalesce("bound", F.lit(float("inf")))).alias("bound"))
        out = np.full(len(self.pivots), -np.inf)
        for r in bound.collect():
            out[r.own] = r.bound
        return out

    def join(self, anchors: DataFrame, near: np.ndarray, far: np.ndarray, k: int, windows: bool) -> DataFrame:
        """Shortlists of anchors over all rows that are, for some cell of the anchor's group, from ``near`` to ``far``.

        Both are distances from anchors of a cell; its reach widens the ring, and
        so does a millionth of the norm, for rounding.
        """
        slack = self.norm * 1e-6
        with np.errstate(all="ignore"):
            outer = np.where(self.full, far + self.reach + slack, -np.inf)
            inner = np.where(self.full, near - self.reach - slack, np.inf)
        rows = self.rows.select("vec_id", "label", "row", "vector", "salt").mapInArrow(partial(_needed, pivots=self.pivots, most=self.norm, inner=inner, outer=outer, group=self.group), f"{_ROWS_DDL}, salt long, group long")
        sizes = F.array(*(F.lit(b) for b in self.blocks))
        count = lambda g: F.element_at(sizes, (g + 1).cast("int"))

        def part(g: Column, b: Column, s: Column) -> Column:
            return (g * max(self.blocks) + b) * self.slices + s

        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), count(F.col("group")) - 1)))
        rows = rows.select(part(F.col("group"), F.col("block"), F.col("salt") % self.slices).alias("part"), F.lit(1).alias("kind"), "vec_id", "label", "row", "vector")
        heads = anchors.withColumn("group", F.element_at(F.array(*(F.lit(int(g)) for g in self.group)), (F.col("cell") + 1).cast("int")).cast("long"))
        heads = heads.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(self.slices - 1)))).withColumn("block", F.pmod(F.xxhash64("vec_id", "row"), count(F.col("group"))))
        heads = heads.select(part(F.col("group"), F.col("block"), F.col("slice")).alias("part"), F.lit(0).alias("kind"), "vec_id", "label", "row", "vector", *(["windows"] if windows else []))
        both = heads.unionByName(rows, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", "kind")
        found = both.mapInArrow(partial(_joined, k=k, width=self.width, windows=windows), _FOUND_DDL)
        nth = F.expr("row_number() OVER (PARTITION BY anchor_id, anchor_row, window ORDER BY score DESC, vec_id, row)")
        return found.dropDuplicates(["anchor_id", "anchor_row", "window", "vec_id", "row"]).withColumn("nth", nth).filter(F.col("nth") <= k)


_RESULT_DDL = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole(emb: DataFrame) -> DataFrame:
    """Rows that take part (vec_id, label, row, vector, salt), components 256 * x rounded down.

    ``salt`` is a number of the row's own, so that copies spread.  From 2**50 on
    256 * x is whole as it is.
    """
    rows = emb.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").filter(F.forall("x", lambda v: v.isNotNull() & (F.abs(256 * v) < float("inf"))))
    rows = rows.select("vec_id", "label", F.transform("x", lambda v: F.when(F.abs(v) < 2.0**50, F.floor(256 * v).cast("double")).otherwise(256 * v)).alias("vector"))
    return rows.withColumn("row", F.xxhash64("label", "vector")).withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 31)))


def mine(emb: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, pivots: int = 64, block: int = 4096, slice_rows: int = 1 << 20) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``emb`` has vec_id, label and embedding; further columns are not read.
    Anchors are rows whose vec_id is divisible by ``every``.  Of an anchor, the
    positives are the first rows of its label, and the negatives of a positive
    the first rows of other labels whose score is from ``low`` to ``high``
    percent of the positive's; a positive of a negative score has none.  Scores
    are inner products of whole-numbered vectors; larger ones come first, ties
    by smaller vec_id.

    Rows without vec_id or label, or with a null or non-finite component (also
    after the multiplication), take no part.  Rows that repeat as a whole count
    once; others of one vec_id are rows of their own.  Shorter vectors count as
    filled up with zeros, also empty ones.  Scores beyond 64 bits count as the
    nearest long.  A table without anchors gives no rows.

    ``pivots`` bounds what the driver and each task know of the cells, ``block``
    is about how many anchors a task holds, ``slice_rows`` about how many rows
    stream past them (there are at least 16 slices).
    """
    spark = emb.sparkSession
    rows = materialize(whole(emb), "negatives-rows")
    n, width, norm = rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))).first()
    anchors = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "label", "row", "vector").dropDuplicates(["vec_id", "row"])
    if not n or anchors.isEmpty():
        return spark.createDataFrame([], _RESULT_DDL)
    cells = Cells(rows, anchors, width, norm, pivots, block, max(16, -(-n // slice_rows)))

    # an anchor is among the rows of its own label, hence one row more
    far = cells.within(positives + 1)
    if norm * norm >= 2.0**62:  # scores that count as the nearest long no longer fall with the distance
        far[:] = np.inf
    found = materialize(cells.join(cells.anchors, np.zeros(len(far)), far, positives, windows=False), "negatives-positives")

    wide = F.col("score").cast("decimal(25,0)")
    window = F.struct(F.col("nth").alias("window"), F.ceil(wide * low / 100).cast("long").alias("low"), F.floor(wide * high / 100).cast("long").alias("high"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = found.filter("score >= 0").groupBy("anchor_id", "anchor_row").agg(F.array_sort(F.collect_list(window)).alias("windows"))
    held = cells.anchors.join(windows, (F.col("vec_id") == F.col("anchor_id")) & (F.col("row") == F.col("anchor_row"))).select("vec_id", "label", "row", "vector", "cell", "windows")
    held = materialize(held, "negatives-windows")

    own = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x) + norm * norm
    ring = held.select("cell", F.sqrt(F.greatest(own - 2 * F.array_min(F.col("windows.low")).cast("double"), F.lit(0.0))).alias("far"), F.sqrt(F.greatest(own - 2 * F.array_max(F.col("windows.high")).cast("double"), F.lit(0.0))).alias("near"))
    near, far = np.full(len(cells.pivots), np.inf), np.full(len(cells.pivots), -np.inf)
    for r in ring.groupBy("cell").agg(F.min("near").alias("near"), F.max("far").alias("far")).collect():
        near[r.cell], far[r.cell] = r.near, r.far
    found = cells.join(held, near, far, negatives, windows=True)
    pairs = held.select(F.col("vec_id").alias("own"), F.col("row").alias("own_row"), F.posexplode("windows").alias("at", "w"))
    joined = found.join(pairs, (F.col("anchor_id") == F.col("own")) & (F.col("anchor_row") == F.col("own_row")) & (F.col("window") == F.col("at") + 1))
    return joined.select("anchor_id", F.col("w.positive_id").alias("positive_id"), F.col("nth").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("w.positive_score").alias("positive_score"), F.col("score").alias("negative_score"))
