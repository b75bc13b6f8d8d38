"""Merkle manifest of a dataset: a tree of digests for each source, and one over the sources.

Nodes of a level are cut into aligned blocks of ``fanout ** depth`` consecutive
ones.  A block is one matrix of 64-byte hexadecimal digests; each level is that
matrix reshaped by the fanout and hashed row by row, and every sibling is found
by index arithmetic.  What a block becomes is one node of the next table, so
trees of any size take few passes, and no task holds more than a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.llm.common import lean, materialize

#: Columns of a document that its leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


# --- matrices of digests ---------------------------------------------------


def matrix(column: pa.Array) -> np.ndarray:
    """Digests of a string column as rows of 64 bytes."""
    return np.frombuffer("".join(column.to_pylist()).encode("ascii"), np.uint8).reshape(-1, 64)


def hash_rows(rows: np.ndarray, widths: np.ndarray | int) -> np.ndarray:
    """Hexadecimal SHA-256 of the first ``widths`` bytes of each row, as rows of 64 bytes."""
    flat, step = memoryview(np.ascontiguousarray(rows)).cast("B"), rows.shape[1]
    ends = np.broadcast_to(widths, len(rows)).tolist()
    raw = np.frombuffer(b"".join(sha256(flat[i * step : i * step + w]).digest() for i, w in enumerate(ends)), np.uint8)
    return _HEX[np.stack([raw >> 4, raw & 15], axis=1)].reshape(-1, 64)


def runs_of(level: np.ndarray, fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``fanout`` consecutive digests as rows, and the bytes each row holds."""
    n = -(-len(level) // fanout)
    rows = np.zeros((n * fanout, 64), np.uint8)
    rows[: len(level)] = level
    widths = np.full(n, fanout * 64)
    widths[-1] = (len(level) - (n - 1) * fanout) * 64
    return rows.reshape(n, fanout * 64), widths


def levels_of(leaves: np.ndarray, height: int, fanout: int) -> list[np.ndarray]:
    """The digests of a block at level 0 and above; level ``height`` is its one node."""
    out = [leaves]
    for _ in range(height):
        out.append(hash_rows(*runs_of(out[-1], fanout)))
    return out


def height_of(total: int, fanout: int, depth: int) -> int:
    """Levels that a block rises: all of ``depth``, or to the root of a tree of one block."""
    height, left = 0, total
    while left > 1 and height < depth:
        left, height = -(-left // fanout), height + 1
    return height


# --- blocks from sorted batches --------------------------------------------


def blocks(batches: Iterator[pa.RecordBatch], fanout: int, depth: int) -> Iterator[tuple[dict | None, pa.RecordBatch, int]]:
    """One block at a time: its head, the batch of its nodes in order, and the levels it rises.

    Columns 0 to 4 are the tree, the block, the place in the tree from 0, its
    number of nodes, and the digest.  A row of place -1 is the head of its block
    and holds what all of its nodes share.
    """
    held: list[pa.RecordBatch] = []

    def joined() -> tuple[dict | None, pa.RecordBatch, int]:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        head = whole.slice(0, 1).to_pylist()[0] if whole.column(2)[0].as_py() < 0 else None
        nodes = whole.slice(1) if head else whole
        return head, nodes, height_of(nodes.column(3)[0].as_py(), fanout, depth)

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((tree[1:] != tree[:-1]) | (block[1:] != block[:-1])) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            at = (tree[start], block[start])
            if held and at != last:
                yield joined()
            held.append(batch.slice(start, end - start))
            last = at
    if held:
        yield joined()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_NODES = pa.schema([("tree", pa.int64()), ("place", pa.int64()), ("total", pa.int64()), ("digest", pa.string())])
_NODES_DDL = "tree long, place long, total long, digest string"


@lean
def _roots(batches: Iterator[pa.RecordBatch], fanout: int, depth: int) -> Iterator[pa.RecordBatch]:
    """Each block as one node of the next table."""
    out: list[tuple] = []
    for _, block, height in blocks(batches, fanout, depth):
        top = levels_of(matrix(block.column(4)), height, fanout)[-1]
        out.append((block.column(0)[0].as_py(), block.column(1)[0].as_py(), -(-block.column(3)[0].as_py() // fanout**depth), top.tobytes().decode("ascii")))
        if len(out) == 4096:
            yield _batch(out, _NODES)
            out = []
    if out:
        yield _batch(out, _NODES)


_STEP = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
_STEPS_DDL = "array<struct<before: string, after: string>>"
_PATHS = pa.schema([("tree", pa.int64()), ("place", pa.int64()), ("path", _STEP), ("top", pa.string())])


def _path(levels: list[np.ndarray], i: int, fanout: int) -> list[dict[str, str]]:
    """What stands left and right of node ``i`` and of each of its ancestors below the top."""
    out = []
    for level in levels[:-1]:
        start = i // fanout * fanout
        out.append({"before": level[start:i].tobytes().decode("ascii"), "after": level[i + 1 : start + fanout].tobytes().decode("ascii")})
        i //= fanout
    return out


@lean
def _paths(batches: Iterator[pa.RecordBatch], fanout: int, depth: int) -> Iterator[pa.RecordBatch]:
    """The path of every node to the root of its tree, carried on from the block's head."""
    for head, block, height in blocks(batches, fanout, depth):
        levels = levels_of(matrix(block.column(4)), height, fanout)
        upper, top = (head["path"], head["top"]) if head else ([], levels[-1].tobytes().decode("ascii"))
        for at in range(0, block.num_rows, 1000):
            part = block.slice(at, 1000)
            steps = [_path(levels, i, fanout) + upper for i in range(at, at + part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(steps, _STEP), pa.array([top] * part.num_rows)], schema=_PATHS)


_PROOFS = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])
_PROOFS_DDL = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


@lean
def _proofs(batches: Iterator[pa.RecordBatch], fanout: int, depth: int) -> Iterator[pa.RecordBatch]:
    """For every leaf: the digest of its siblings up to the root, and the root folded from column 5."""
    for head, block, height in blocks(batches, fanout, depth):
        levels, n = levels_of(matrix(block.column(4)), height, fanout), block.num_rows
        at, fold, proofs = np.arange(n), matrix(block.column(5)), [sha256() for _ in range(n)]
        for level in levels[:-1]:
            rows, widths = runs_of(level, fanout)
            rows, widths, own = rows[at // fanout], widths[at // fanout], at % fanout * 64
            for p, row, w, o in zip(proofs, rows, widths.tolist(), own.tolist(), strict=True):
                p.update(row[:o])
                p.update(row[o + 64 : w])
            np.put_along_axis(rows, own[:, None] + np.arange(64), fold, axis=1)
            fold, at = hash_rows(rows, widths), at // fanout
        for step in head["path"]:
            before, after = (step[k].encode("ascii") for k in ("before", "after"))
            for p in proofs:
                p.update(before + after)
            left, right = (np.broadcast_to(np.frombuffer(x, np.uint8), (n, len(x))) for x in (before, after))
            rows = np.hstack([left, fold, right])
            fold = hash_rows(rows, rows.shape[1])
        folded = fold.tobytes().decode("ascii")
        folded = [folded[i : i + 64] for i in range(0, len(folded), 64)]
        shared = [pa.array([head[k]] * n) for k in ("top", "root")]
        yield pa.RecordBatch.from_arrays([block.column(6), block.column(4), *shared, pa.array([p.hexdigest() for p in proofs]), pa.array(folded), pa.array([f == head["root"] for f in folded])], schema=_PROOFS)


# --- tables of nodes -------------------------------------------------------


def by_block(nodes: DataFrame, heads: DataFrame | None, fanout: int, depth: int) -> DataFrame:
    """Nodes dealt out by aligned block, in order, below the heads of their blocks.

    A tree of any size spreads over as many keys as it has blocks, and what the
    nodes of a block share goes to its task once.
    """
    names = [c for c in nodes.columns if c not in ("tree", "place")]
    rows = nodes.select("tree", F.expr(f"place div {fanout**depth}").alias("block"), "place", *names)
    if heads is not None:
        rows = rows.unionByName(heads.withColumnRenamed("place", "block").withColumn("place", F.lit(-1).cast("long")), allowMissingColumns=True)
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def roots(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """The blocks of nodes (tree, place, total, digest) as nodes of the next table."""
    rows = by_block(nodes.select("tree", "place", "total", "digest"), None, fanout, depth)
    return materialize(rows.mapInArrow(partial(_roots, fanout=fanout, depth=depth), _NODES_DDL), "merkle-blocks")


def paths(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """(tree, place, path, top) of nodes (tree, place, total, digest), over as many passes as the largest tree needs."""
    heads, most = None, nodes.agg(F.max("total")).first()[0] or 0
    if most > fanout**depth:
        heads = paths(roots(nodes, fanout, depth), fanout, depth)
    rows = by_block(nodes.select("tree", "place", "total", "digest"), heads, fanout, depth)
    return materialize(rows.mapInArrow(partial(_paths, fanout=fanout, depth=depth), f"tree long, place long, path {_STEPS_DDL}, top string"), "merkle-paths")


@lean
def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of each in its run of equal first columns, in the order of the task."""
    last: object = batches  # equals no key
    seen = 0
    for batch in batches:
        numbers = []
        for key in batch.column(0).to_pylist():
            seen = seen + 1 if key == last else 0
            last = key
            numbers.append(seen)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, "nth"])


def ranked(rows: DataFrame, group: str, order: list[Column], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with (task, nth), and a small table (at, own, moved, total) that makes ``nth + moved`` the place in the group.

    Rows are dealt by ranges of group and order, so a group spans as many tasks
    as it fills; numbers of a task are moved by the counts of those before it.
    """
    first = F.col(group).asc_nulls_first()
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.select(group, *(c for c in rows.columns if c != group)).repartitionByRange(parts, first, *order, F.monotonically_increasing_id()).sortWithinPartitions(first, *order)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    kept = materialize(ranged.mapInArrow(_numbered, f"{shape}, nth long").withColumn("task", F.spark_partition_id()), name)
    counts = kept.groupBy("task", group).agg((F.max("nth") + 1).alias("n"))
    return kept, counts.selectExpr("task AS at", f"`{group}` AS own", f"sum(n) OVER (PARTITION BY `{group}` ORDER BY task) - n AS moved", f"sum(n) OVER (PARTITION BY `{group}`) AS total")


# --- documents -------------------------------------------------------------


def leaf(text: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """The digest of a document's fields; ``text`` stands for the last one."""
    parts = [F.col(f).cast("string") for f in fields[:-1]] + [text]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts)), 256)


def tampered() -> Column:
    """Whether a document's text loses its line feeds; one without an id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))


def manifest(docs: DataFrame, changed: Callable[[], Column] = tampered, fanout: int = 3, depth: int = 8) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document.

    ``docs`` has the columns of ``FIELDS``; others are not read.  Leaves of a
    source ascend by doc_id (null first, ties by leaf); sources ascend by their
    UTF-8 bytes (null first).  Where ``changed()`` holds, the root is folded
    from a text without line feeds, and else from the text as it is.  Rows that
    repeat as a whole are leaves of their own with equal digests; which of their
    places each one gets makes no difference to the set of results.  Null fields
    count as ``-``, empty texts as texts.  A table without rows gives none.
    """
    cut = F.when(changed() & F.col("text").contains("\n"), leaf(F.replace("text", F.lit("\n"), F.lit("")))).otherwise(F.col("leaf"))
    rows = docs.select(*(F.col(f).cast("string" if f in ("source", "lang", "text") else "long") for f in FIELDS))
    leaves = materialize(rows.withColumn("leaf", leaf(F.col("text"))).select("source", "doc_id", "leaf", cut.alias("cut")), "merkle-leaves")
    kept, moved = ranked(leaves, "source", [F.col("doc_id").asc_nulls_first(), F.col("leaf")], "merkle-ranked")

    # the sources are the leaves of one more tree; their places in it number their own trees
    names, shift = ranked(moved.select(F.col("own").alias("name")).distinct().withColumn("one", F.lit(0)), "one", [F.col("name").asc_nulls_first()], "merkle-sources")
    names = names.join(shift, F.col("task") == F.col("at")).select("name", (F.col("nth") + F.col("moved")).alias("tree"), F.col("total").alias("trees"))
    names = materialize(names, "merkle-trees")
    moved = moved.join(names, F.col("own").eqNullSafe(F.col("name")))
    nodes = kept.join(moved, (F.col("task") == F.col("at")) & F.col("source").eqNullSafe(F.col("own")))
    nodes = materialize(nodes.select("tree", (F.col("nth") + F.col("moved")).alias("place"), "total", F.col("leaf").alias("digest"), "cut", "doc_id"), "merkle-nodes")

    inner = paths(roots(nodes, fanout, depth), fanout, depth)
    subroots = inner.filter("place = 0").select("tree", F.col("top").alias("digest")).join(names, "tree")
    subroots = materialize(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("trees").alias("total"), "digest"), "merkle-subroots")
    outer = paths(subroots, fanout, depth).select(F.col("place").alias("tree"), F.col("path").alias("outer"), F.col("top").alias("root"))
    heads = inner.join(outer, "tree").select("tree", "place", F.concat("path", "outer").alias("path"), "top", "root")
    return by_block(nodes, heads, fanout, depth).mapInArrow(partial(_proofs, fanout=fanout, depth=depth), _PROOFS_DDL)
