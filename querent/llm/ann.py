"""Approximate nearest neighbours: NN-descent graph and greedy graph search.

Vectors that are equal are one node.  The graph starts from leaves of random
hyperplane trees.  Each round of NN-descent joins the edges of every node, in
both directions, with the vectors at their ends; neighbours of one node are
compared with each other, and every node keeps its nearest; rounds go on until
hardly an edge is new.  A query walks the graph: its state is a beam of its
nearest nodes so far, one row however long the walk.  A step joins the nearest
nodes of the beam that were not expanded yet with the graph, what it finds there
with the vectors, and merges both; the walk ends when all of its beam has been
expanded.  A few queries are also compared with all vectors; while the walks find
too few of their nearest, all walks go on with a wider beam.

Graph and walks use half-precision copies with a scale each, to keep shuffles
small; what a walk ends with is measured in double precision on the original
vectors and ranked by that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querent.llm.common import discard, lean, materialize
from querent.llm.ngram_join import _groups


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>) of rows that can take part."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = "size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    return rows.filter(fine)


def of_one_length(rows: DataFrame) -> DataFrame:
    """The rows whose vectors have the commonest length (of equally common ones the greatest)."""
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(2).collect()
    return rows.filter(F.size("v") == lengths[0].n) if len(lengths) > 1 else rows


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.float64())])


def _bytes(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    at = np.frombuffer(col.buffers()[1], wide)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(col), -1)


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    raw = _bytes(col)
    return raw[:, 8:].copy().view("<f2").astype(np.float64) * raw[:, :8].copy().view("<f8")


def packed(v: np.ndarray) -> list[bytes]:
    """A scale and half-precision parts of each row; no row is zero."""
    scale = np.abs(v).max(axis=1)
    return [s.tobytes() + x.tobytes() for s, x in zip(scale, (v / scale[:, None]).astype("<f2"), strict=True)]


def _emit(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], schema=_EDGES)


def _runs(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by ``key``: about ``rows`` rows, or one larger group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held += [batch] if batch.num_rows else []
        if sum(b.num_rows for b in held) >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            c = t.column(key).to_numpy()
            cut = int(np.searchsorted(c, c[-1]))
            if cut:
                yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


@lean
def _leaf(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Nearest neighbours inside each leaf."""
    for t in _groups(batches, ["leaf", "part"]):
        if t.num_rows > 1:
            ids, x = t.column("node").to_numpy(), _matrix(t.column("q"))
            n = (x * x).sum(axis=1)
            d = np.maximum(n[:, None] + n[None, :] - 2 * (x @ x.T), 0)
            np.fill_diagonal(d, np.inf)
            near = min(k, len(ids) - 1)
            at = np.argpartition(d, near - 1, axis=1)[:, :near]
            dist = np.take_along_axis(d, at, axis=1)
            ok = np.isfinite(dist)
            yield _emit(np.broadcast_to(ids[:, None], at.shape)[ok], ids[at][ok], dist[ok])


@lean
def _local(batches: Iterator[pa.RecordBatch], k: int, groups: int = 256) -> Iterator[pa.RecordBatch]:
    """Local joins, many nodes at a time: the neighbours of each node against each other, fresh pairs only."""
    for t in _runs(batches, "a", 1 << 13):
        a, b, fresh, worst = (t.column(c).to_numpy() for c in ("a", "b", "fresh", "worst"))
        x = _matrix(t.column("q"))
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        group = np.repeat(np.arange(len(first)), np.diff([*first, len(a)]))
        for g in range(0, len(first), groups):
            own = slice(first[g], first[g + groups] if g + groups < len(first) else len(a))
            row, size = group[own] - g, np.bincount(group[own] - g)
            place, most = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size), int(size.max())
            if most < 2:
                continue
            shape = (len(size), most)
            ids, new, limit, v = np.zeros(shape, np.int64), np.zeros(shape, bool), np.full(shape, -np.inf), np.zeros((*shape, x.shape[1]))
            ids[row, place], new[row, place], limit[row, place], v[row, place] = b[own], fresh[own], worst[own], x[own]
            n = (v * v).sum(axis=2)
            d = np.maximum(n[:, :, None] + n[:, None, :] - 2 * (v @ v.transpose(0, 2, 1)), 0)
            used = np.arange(most) < size[:, None]
            d[~((new[:, :, None] | new[:, None, :]) & used[:, None, :])] = np.inf
            d[:, np.arange(most), np.arange(most)] = np.inf
            near = min(k, most - 1)
            at = np.argpartition(d, near - 1, axis=2)[:, :, :near]
            dist = np.take_along_axis(d, at, axis=2)
            ok = dist < limit[:, :, None]
            ends = np.take_along_axis(np.broadcast_to(ids[:, None, :], d.shape), at, axis=2)
            yield _emit(np.broadcast_to(ids[:, :, None], at.shape)[ok], ends[ok], dist[ok])


_ROUTED = pa.schema([("node", pa.int64()), ("q", pa.binary()), ("tree", pa.int32()), ("leaf", pa.int64())])


@lean
def _route(batches: Iterator[pa.RecordBatch], trees: int, depth: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The leaf of each vector in each tree: signs against fixed random hyperplanes."""
    planes = None
    for batch in batches:
        x = _matrix(batch.column(1))
        if planes is None:
            planes = np.random.default_rng(seed).standard_normal((trees, depth, x.shape[1]))
        for i in range(trees):
            side = (x @ planes[i].T > 0).astype(np.int64)
            leaf = (side << np.arange(depth)).sum(axis=1) + (i << 40)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(x), i, np.int32)), pa.array(leaf)], schema=_ROUTED)


def _top(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node's edges; a partial top-k comes before the shuffle-heavy sort."""
    best = edges.groupBy("a", "b").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    return best.withColumn("r", rank).filter(F.col("r") <= k)


def build_graph(nodes: DataFrame, n: int, k: int = 32, most_rounds: int = 60, trees: int = 8, leaf: int = 256, sample: int = 16, seed: int = 5) -> DataFrame:
    """(a, b, d, fresh, r): each node's k nearest known neighbours.

    ``nodes`` is (node, q): an id and its vector as ``packed`` gives it.  A
    round compares at most ``sample`` new and ``sample`` old edges a node; its
    further new edges stay new for later rounds.  Rounds end when under 0.2
    percent of the edges are new; ``most_rounds`` without that is an error.
    ``trees`` is the least number of trees; it grows with the logarithm of n.
    """
    trees = max(trees, int(np.ceil(np.log2(max(2, n)))) - 6)
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    routed = nodes.mapInArrow(partial(_route, trees=trees, depth=depth, seed=seed), "node long, q binary, tree int, leaf long")
    #: Signs may leave a leaf too full; it is split by a hash.
    counts = materialize(routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("c")), "leaves")
    dealt = routed.join(counts, "leaf").withColumn("part", F.expr(f"pmod(xxhash64(node, leaf), ceil(c / {2 * leaf}))")).select("leaf", "part", "node", "q")
    first = dealt.repartition("leaf", "part").sortWithinPartitions("leaf", "part").mapInArrow(partial(_leaf, k=k // 2), "a long, b long, d double")
    graph = materialize(_top(first.withColumn("fresh", F.lit(True)), k), "graph")
    for _ in range(most_rounds):
        ends = graph.select("a", "b", "d", "fresh", F.col("fresh").alias("own_fresh"), F.lit(True).alias("own")).union(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "d", "fresh", F.lit(False), F.lit(False)))
        ends = ends.groupBy("a", "b").agg(F.min("d").alias("d"), F.max("fresh").alias("fresh"), F.max("own_fresh").alias("own_fresh"), F.max("own").alias("own"))
        pick = F.row_number().over(Window.partitionBy("a", "fresh").orderBy("d", "b"))
        ends = materialize(ends.withColumn("p", pick).filter((F.col("p") <= sample) | F.col("own")), "ends")
        #: A new edge that is not compared in this round waits: it stays new.
        known = ends.filter("own").select("a", "b", "d", (F.col("own_fresh") & (F.col("p") > sample)).alias("fresh"))
        worst = graph.groupBy("a").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).otherwise(float("inf")).alias("worst")).withColumnRenamed("a", "b")
        joined = ends.filter(F.col("p") <= sample).select("a", "b", "fresh").join(nodes.select(F.col("node").alias("b"), "q").join(worst, "b", "left").fillna(float("inf"), ["worst"]), "b")
        found = joined.select("a", "b", "fresh", "worst", "q").repartition("a").sortWithinPartitions("a").mapInArrow(partial(_local, k=8), "a long, b long, d double")
        #: fresh is false as soon as an edge was compared before (min over both).
        old, graph = graph, materialize(_top(found.withColumn("fresh", F.lit(True)).union(known), k), "graph")
        discard(old, ends)
        if graph.filter("fresh").count() <= 0.002 * n * k:
            return graph
    raise RuntimeError(f"the neighbour graph did not converge in {most_rounds} rounds")


@lean
def _scan(batches: Iterator[pa.RecordBatch], ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest other nodes of each probe, in every batch of (node, v)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node, v = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
        d = (x * x).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * (x @ v.T)
        d[ids[:, None] == node[None, :]] = np.inf
        at = np.argpartition(d, min(k, len(node)) - 1, axis=1)[:, :k]
        for i, w in enumerate(ids):
            near = at[i][node[at[i]] != w]
            if len(near):
                exact = np.sqrt(((v[near] - x[i]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), w)), pa.array(node[near]), pa.array(exact)], names=["w", "b", "d"])


def _truth(walks: DataFrame, nodes: DataFrame, probes: int, k: int) -> DataFrame:
    """(w, kth, want) of at most ``probes`` walks, by a scan of all nodes: the distance of the k-th nearest and their number."""
    rows = walks.orderBy(F.xxhash64("w"), "w").limit(probes).collect()
    ids, x = np.array([r.w for r in rows], np.int64), np.array([r.qv for r in rows], float)
    near = nodes.select("node", "v") if rows else nodes.select("node", "v").limit(0)
    near = near.mapInArrow(partial(_scan, ids=ids, x=x, k=k), "w long, b long, d double")
    place = F.row_number().over(Window.partitionBy("w").orderBy("d", "b"))
    top = near.withColumn("place", place).filter(F.col("place") <= k)
    return materialize(top.groupBy("w").agg(F.max("d").alias("kth"), F.count(F.lit(1)).alias("want")), "truth")


def _recall(near: DataFrame, truth: DataFrame) -> float:
    """The share of the probes' nearest that their walks have found, ties counted by distance."""
    met = near.join(F.broadcast(truth), "w").filter("b <> w AND d <= kth * (1 + 1e-9)").groupBy("w").agg(F.count(F.lit(1)).alias("met"))
    row = truth.join(met, "w", "left").agg(F.sum(F.least(F.coalesce("met", F.lit(0)), "want")), F.sum("want")).first()
    return row[0] / row[1] if row[1] else 1.0


#: A walk: its node and vector, and its beam as arrays in the order of (distance, id).
_WALK = pa.schema([("w", pa.int64()), ("q", pa.binary()), ("ids", pa.binary()), ("ds", pa.binary()), ("done", pa.binary()), ("open", pa.bool_())])
_WALK_DDL = "w long, q binary, ids binary, ds binary, done binary, open boolean"


def _due(done: np.ndarray, expand: int) -> np.ndarray:
    """Places in the beam that the next step expands: the nearest that are not done."""
    return np.flatnonzero(~done)[:expand]


@lean
def _front(batches: Iterator[pa.RecordBatch], expand: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w, ids, done in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            at = np.frombuffer(ids, "<i8")[_due(np.frombuffer(done, bool), expand)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), w)), pa.array(at)], ["w", "node"])


@lean
def _merge(batches: Iterator[pa.RecordBatch], beam: int, expand: int) -> Iterator[pa.RecordBatch]:
    """A step of each walk: its row comes first, then what its expanded nodes are linked with."""
    for t in _groups(batches, ["w"]):
        w, q, ids, ds, done = (t.column(c)[0].as_py() for c in ("w", "q", "ids", "ds", "done"))
        ids, ds, done = np.frombuffer(ids, "<i8"), np.frombuffer(ds, "<f8"), np.frombuffer(done, bool).copy()
        done[_due(done, expand)] = True
        if t.num_rows > 1:
            more = t.slice(1)
            new = more.column("b").to_numpy()
            fresh = ~np.isin(new, ids)
            x = _matrix(more.column("q"))[fresh] - _matrix(pa.array([q], pa.binary()))
            ids, ds, done = np.concatenate([ids, new[fresh]]), np.concatenate([ds, (x * x).sum(axis=1)]), np.concatenate([done, np.zeros(len(x), bool)])
            order = np.lexsort((ids, ds))[:beam]
            ids, ds, done = ids[order], ds[order], done[order]
        yield pa.RecordBatch.from_pylist([{"w": w, "q": q, "ids": ids.tobytes(), "ds": ds.tobytes(), "done": done.tobytes(), "open": not done.all()}], _WALK)


@lean
def _reopen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The walks with nothing of their beams done."""
    for batch in batches:
        done = pa.array([bytes(len(d)) for d in batch.column(4).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], done, pa.array([True] * batch.num_rows)], schema=_WALK)


@lean
def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            b = np.frombuffer(ids, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), w)), pa.array(b)], ["w", "b"])


@lean
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Euclidean distances of (w, b, v, qv), in double precision on the original vectors."""
    for batch in batches:
        if batch.num_rows:
            v, qv = (batch.column(i).flatten().to_numpy().reshape(batch.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.sqrt(((v - qv) ** 2).sum(axis=1)))], ["w", "b", "d"])


def search(vectors: DataFrame, every: int = 100, k: int = 10, beam: int = 256, expand: int = 48, most_steps: int = 400, graph_k: int = 32, most_links: int = 128, recall: float = 0.93, probes: int = 200, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows of each query row, itself left out.

    Queries are the rows whose id is divisible by ``every``; all other rows are
    candidates.  Nearness is Euclidean distance in double precision, ties to the
    smaller id; fewer candidates give fewer rows.  Vectors that are null, empty,
    zero or hold null or non-finite parts take no part, nor do vectors of
    another length than the commonest; of rows with one id the smallest vector
    counts.  Extra columns are not read; an empty table gives an empty one.

    A node is linked with its ``graph_k`` neighbours and with those it is a
    neighbour of, the nearest ``most_links`` in all.  Up to ``probes`` queries
    are compared with all vectors.  ``beam`` and ``expand`` are doubled, for all
    queries, until the walks have found at least ``recall`` of the probes'
    nearest; it is an error if a beam of all nodes or ``most_steps`` steps do
    not get there.

    Returns query_id, rank, vec_id, score.
    """
    rows = of_one_length(usable(vectors, id_col, vec_col)).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = materialize(rows.withColumn("h", F.xxhash64("v")), "vectors")
    classes = rows.groupBy("h", "v").agg(F.min("vec_id").alias("node"))
    nodes = materialize(classes.select("node", "v").mapInArrow(_pack, "node long, v array<double>, q binary"), "nodes")
    member = materialize(rows.join(classes.select("h", "v", "node"), ["h", "v"]).select("node", "vec_id"), "members")
    n = nodes.count()
    graph = build_graph(nodes.select("node", "q"), n, k=graph_k)
    both = graph.select("a", "b", "d").union(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).groupBy("a", "b").agg(F.min("d").alias("d"))
    near_links = both.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).filter(F.col("r") <= most_links)
    links = materialize(near_links.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("linked")), "links")

    queries = member.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query"), F.col("node").alias("home"))
    #: Queries that are equal walk once.
    walks = queries.select(F.col("home").alias("w")).distinct().join(nodes.withColumnRenamed("node", "w"), "w")
    walks = materialize(walks.select("w", F.col("v").alias("qv"), "q"), "walks")
    truth = _truth(walks, nodes, probes, k)
    points = nodes.select(F.col("node").alias("b"), "q")
    start = [F.expr(f"unhex('{x.tobytes().hex()}')") for x in (np.zeros(1, "<f8"), np.zeros(1, bool))]
    #: Long integers as bytes, least first.
    home = F.expr("unhex(array_join(reverse(regexp_extract_all(lpad(hex(w), 16, '0'), '(..)', 1)), ''))")
    state = materialize(walks.select("w", "q", home.alias("ids"), start[0].alias("ds"), start[1].alias("done"), F.lit(True).alias("open")), "walk")
    ended: list[DataFrame] = []
    for _ in range(most_steps):
        if state.isEmpty():
            finished = ended[0] if ended else state
            for part in ended[1:]:
                finished = finished.union(part)
            found = finished.select("w", "ids").mapInArrow(_members, "w long, b long").join(nodes.select(F.col("node").alias("b"), "v"), "b")
            near = found.join(walks.select("w", "qv"), "w").select("w", "b", "v", "qv").mapInArrow(_measure, "w long, b long, d double")
            near = materialize(near, "near")
            share = _recall(near, truth)
            if share >= recall:
                break
            if beam >= n:
                raise RuntimeError(f"the walks end with {share:.3f} of the probes' nearest; {recall} is wanted")
            beam, expand = 2 * beam, 2 * expand
            state, ended = materialize(finished.mapInArrow(_reopen, _WALK_DDL), "walk"), []
        front = state.select("w", "ids", "done").mapInArrow(partial(_front, expand=expand), "w long, node long")
        hops = front.join(links, "node").select("w", F.explode("linked").alias("b")).distinct().join(points, "b")
        nothing = [F.lit(None).cast("binary").alias(c) for c in ("ids", "ds", "done")]
        both = state.select("w", F.lit(None).cast("long").alias("b"), "q", "ids", "ds", "done").union(hops.select("w", "b", "q", *nothing))
        state = both.repartition("w").sortWithinPartitions("w", "b").mapInArrow(partial(_merge, beam=beam, expand=expand), _WALK_DDL)
        state = materialize(state, "walk")
        ended.append(state.filter("NOT open"))
        state = state.filter("open")
    else:
        raise RuntimeError(f"the walks did not end in {most_steps} steps")

    place = F.row_number().over(Window.partitionBy("w").orderBy("d", "b"))
    near = near.withColumn("place", place).filter(F.col("place") <= k + 1)
    #: Each class gives its k + 1 smallest ids: more cannot be among the nearest.
    wanted = member.join(near.select(F.col("b").alias("node")).distinct(), "node", "left_semi")
    salted = wanted.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    cut = salted.withColumn("m", F.row_number().over(Window.partitionBy("node", "salt").orderBy("vec_id"))).filter(F.col("m") <= k + 1)
    cut = cut.withColumn("m", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).filter(F.col("m") <= k + 1)
    found = queries.join(near, queries.home == near.w).join(cut.select(F.col("node").alias("b"), "vec_id"), "b").filter("vec_id <> query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("query").alias("query_id"), F.col("rank").cast("int"), "vec_id", F.col("d").alias("score"))


_NODES = pa.schema([("node", pa.int64()), ("v", pa.list_(pa.float64())), ("q", pa.binary())])


@lean
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            v = batch.column(1)
            q = packed(v.flatten().to_numpy().reshape(len(v), -1))
            yield pa.RecordBatch.from_arrays([batch.column(0), v.cast(pa.list_(pa.float64())), pa.array(q, pa.binary())], schema=_NODES)
