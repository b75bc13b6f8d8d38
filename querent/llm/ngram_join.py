"""N-gram Jaccard join with a count-vector R-tree.

The tokens of a document (its distinct word shingles) are hashed into groups.

1. *Shards.*  With at most D differing tokens allowed and more than D groups,
   two linked sets agree completely in at least one group.  So each document
   goes to one shard per group, keyed by a digest of the tokens in the group,
   and no link is missed.  D follows from the size band; a document near a
   band's lower end also goes to the band below.
2. *R-tree.*  In each shard the group counts are points of an R-tree.  The sum
   of coordinate minima bounds the overlap from above; pairs whose bound meets
   the threshold survive.
3. *Verification.*  Surviving pairs are checked on whole texts.

A shard may hold most of the corpus.  It is cut into blocks of at most
``block`` points, and the first search asks each point only for its best
partner, so the number of pairs is linear.  Shards still divided between
components are searched in full a second time, for points that have survivors in
another component.  Those few meet again with their texts, and survivors are
verified in place, best bound first; a pair whose components a link has joined
already is passed over, so a tile gives fewer points and links than it has points.

Texts are moved once, packed, and only those of documents in shared shards.

Identical sets are joined first, by a 128-bit digest; one document of each
class takes part further on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import GOLDEN, components, discard, encode, lean, materialize, mix64, text_parts
from querent.llm.rtree import CountTree
from querent.llm.shingles import overlap, sets_of

DIMS = 256
_BAND = 1.5


def bands(most: int) -> list[int]:
    """Lower ends of the size bands up to the one that holds ``most``."""
    ends = [1]
    while ends[-1] <= most:
        ends.append(int(np.ceil(ends[-1] * _BAND)))
    return ends


def plan(low: int, high: int, num: int, den: int) -> tuple[int, int]:
    """(D, groups) for a pair whose smaller set has low <= n < high tokens."""
    n = high - 1
    total = n + n * den // num
    d = total - 2 * -(-total * num // (num + den))
    d = max(0, d)
    mean = max(0.5, (low + n) / 2 / (d + 1))
    return d, d + 2 + int(np.ceil((d + 1) * min(1.0, 1.5 * np.exp(-mean))))


def shard_keys(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """Digests of the token groups under which a set can meet its partners."""
    n = len(tokens)
    ends, out = bands(n), []
    home = len(ends) - 2
    for band in (home, home - 1):
        if band < 0 or band < home and n * num > (ends[home] - 1) * den:
            continue
        d, groups = plan(ends[band], ends[band + 1], num, den)
        if not d:
            continue  # only identical sets link
        group = (tokens >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        digest = np.add.reduceat(mix64(tokens ^ GOLDEN), first)
        tag = np.array([band + 1], np.uint64) * GOLDEN
        out.append(mix64(digest + mix64(group[first] + tag)))
        if groups - len(first) >= groups - d:  # agreement may be on empty groups only
            out.append(mix64(tag))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])


def _digests(tokens: np.ndarray) -> list[int]:
    return [int(mix64(tokens + c).sum(dtype=np.uint64).astype(np.int64)) for c in (GOLDEN, np.uint64(1))]


@lean
def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(len(tokens), *_digests(tokens)) for part in text_parts(batch, 1) for tokens in sets_of(part, k)]
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], schema=_SETS)


_TEXTS = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("vec", pa.binary()), ("size", pa.int64()), ("z", pa.binary())])


@lean
def _texts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Count vectors of sets, and compressed texts to verify links on."""
    for batch in batches:
        at = 0
        for part in text_parts(batch, 1):
            rows = []
            for text, tokens in zip(part, sets_of(part, k), strict=True):
                vec = np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=DIMS)
                raw = encode([text])[0]
                rows.append((len(tokens), vec.astype("<u2" if vec.max() < 1 << 16 else "<u4").tobytes(), len(raw), pa.compress(raw, "zstd", asbytes=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(_TEXTS)[1:], strict=True))], schema=_TEXTS)
            at += len(part)


def _unpacked(size: int, z: bytes) -> str:
    return pa.decompress(z, size, "zstd", asbytes=True).decode() if size else ""


_KEYS = pa.schema([("doc", pa.int64()), ("s1", pa.int64()), ("key", pa.int64())])


@lean
def _keys(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """A row for each document and shard."""
    for batch in batches:
        docs = iter(batch.column(0).to_pylist())
        for part in text_parts(batch, 1):
            found: list[np.ndarray] = []
            for tokens, doc in zip(sets_of(part, k), docs):  # in this order: an exhausted part takes no id
                if len(tokens):
                    keys = shard_keys(tokens, num, den).astype(np.int64)
                    found.append(np.stack([np.full(len(keys), doc), np.full(len(keys), _digests(tokens)[0]), keys]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(found, axis=1)], schema=_KEYS)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows that agree in ``keys``, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        cut = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1).tolist(), batch.num_rows]
        if held:
            last = [held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() for k in keys]
            if last != [c[0] for c in cols]:
                yield pa.Table.from_batches(held)
                held = []
        for a, b in zip(cut[:-2], cut[1:-1], strict=True):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(cut[-2]))
    if held:
        yield pa.Table.from_batches(held)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _points(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vec = np.stack([np.frombuffer(v, "<u2" if len(v) == 2 * DIMS else "<u4") for v in t.column("vec").to_pylist()])
    return t.column("doc").to_numpy(), vec, t.column("n").to_numpy()


def _flush(pairs: list[np.ndarray]) -> pa.RecordBatch:
    x = np.concatenate(pairs)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], schema=_PAIRS)


@lean
def _best(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Each point's best partner among those before it; the block's centre is first."""
    out: list[np.ndarray] = []
    for t in _groups(batches, ["key", "block"]):
        docs, vec, n = _points(t)
        if len(docs) < 2:
            continue
        rank = np.empty(len(docs), np.int64)
        rank[np.lexsort((docs, ~t.column("centre").to_numpy(zero_copy_only=False)))] = np.arange(len(docs))
        tree, found = CountTree(vec, n, num, den), []
        for i in range(len(docs)):
            idx, bound = tree.search(i)
            ok = (rank[idx] < rank[i]) & (docs[idx] != docs[i])
            if ok.any():
                idx, bound = idx[ok], bound[ok]
                j = idx[np.lexsort((rank[idx], n[idx] - 2 * bound))[0]]
                found.append((min(docs[i], docs[j]), max(docs[i], docs[j])))
        if found:
            out.append(np.array(found, np.int64))
        if sum(map(len, out)) > 20_000:
            yield _flush(out)
            out = []
    if out:
        yield _flush(out)


def _links(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    inter = overlap(x, y)
    return den * inter >= num * (len(x) + len(y) - inter)


_CROSSING = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("doc", pa.int64()), ("label", pa.int64()), ("own", pa.bool_())])


@lean
def _crossing(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The points of each tile that may link across components: minority points with survivors, and those."""
    for t in _groups(batches, ["key", "block"]):
        _, vec, n = _points(t)
        label, own = t.column("label").to_numpy(), t.column("own").to_numpy()
        tree, hit = CountTree(vec, n, num, den), np.zeros(len(n), bool)
        for i in np.flatnonzero(own).tolist():
            idx, _ = tree.search(i)
            idx = idx[label[idx] != label[i]]
            if len(idx):
                hit[i] = hit[idx] = True
        if hit.any():
            yield from t.select(_CROSSING.names).filter(pa.array(hit)).combine_chunks().to_batches()


@lean
def _across(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Links that join the components of the tile's minority points with others: a spanning forest of them."""
    for t in _groups(batches, ["key", "block"]):
        docs, vec, n = _points(t)
        label, own = t.column("label").to_numpy(), t.column("own").to_numpy(zero_copy_only=False)
        size, z = t.column("size").to_pylist(), t.column("z").to_pylist()
        tree, out, above, known = CountTree(vec, n, num, den), [], {}, {}

        def root(x: int) -> int:
            while (y := above.get(x, x)) != x:
                above[x] = above.get(y, y)
                x = y
            return x

        def tokens(i: int) -> np.ndarray:
            if i not in known:
                known[i] = next(sets_of([_unpacked(size[i], z[i])], k))
            return known[i]

        for i in np.flatnonzero(own).tolist():
            idx, bound = tree.search(i)
            other = label[idx] != label[i]
            idx, bound = idx[other], bound[other]
            for j in idx[np.argsort(n[idx] - 2 * bound, kind="stable")].tolist():
                a, b = root(int(label[i])), root(int(label[j]))
                if a != b and _links(tokens(i), tokens(j), num, den):
                    above[max(a, b)] = min(a, b)
                    out.append((min(docs[i], docs[j]), max(docs[i], docs[j])))
        if out:
            yield _flush([np.array(out, np.int64)])


@lean
def _verify(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            pairs = list(zip(*(part.column(c).to_pylist() for c in (2, 3)), strict=True)), list(zip(*(part.column(c).to_pylist() for c in (4, 5)), strict=True))
            own = list(dict.fromkeys(pairs[0]))  # a centre's text recurs
            first = dict(zip(own, sets_of([_unpacked(*x) for x in own], k), strict=True))
            keep = [_links(first[x], y, num, den) for x, y in zip(pairs[0], sets_of([_unpacked(*x) for x in pairs[1]], k), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], schema=_PAIRS).filter(pa.array(keep))


def verify(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of documents whose shingle sets do link."""
    x = pairs.join(texts.select(F.col("doc").alias("a"), F.col("size").alias("na"), F.col("z").alias("za")), "a")
    x = x.join(texts.select(F.col("doc").alias("b"), F.col("size").alias("nb"), F.col("z").alias("zb")), "b").select("a", "b", "na", "za", "nb", "zb")
    return x.mapInArrow(partial(_verify, k=k, num=num, den=den), "a long, b long")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, block: int = 2048) -> DataFrame:
    """Classes of documents linked by shingle-set similarity.

    Two documents link when ``den * intersection >= num * union`` of their
    distinct ``k``-word shingles (words are lower-cased in A-Z).  Fewer than k
    words: the whole sequence is one shingle.  Null, empty and blank texts have
    empty sets and link with nothing.  Rows that repeat an id count once, with
    the smallest text; null ids are kept out.  Extra columns are not read.

    Returns doc_id, n_shingles, component_id (the smallest reachable doc_id).
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL")
    make_sets = partial(_sets, k=k)
    sets = materialize(docs.mapInArrow(make_sets, "doc_id long, n long, s1 long, s2 long"), "sets")
    if not sets.groupBy("doc_id").count().filter("count > 1").isEmpty():
        discard(sets)
        docs = materialize(docs.groupBy("doc_id").agg(F.min("text").alias("text")), "docs")
        sets = materialize(docs.mapInArrow(make_sets, "doc_id long, n long, s1 long, s2 long"), "sets")
    classes = materialize(sets.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select("rep")

    #: A shard counts if it holds different sets; copies of one set do not make it one.
    #: Keys are made from the texts each time they are read: kept, they would outweigh the input.
    spread = docs.mapInArrow(partial(_keys, k=k, num=num, den=den), "doc long, s1 long, key long")
    shared = materialize(spread.groupBy("key").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).filter("lo <> hi").select("key"), "shared", heavy=True)
    #: What grows with the corpus is joined by a shuffle at every size, never broadcast.
    touched = spread.select("doc", "key").join(shared.hint("merge"), "key").join(reps.withColumnRenamed("rep", "doc").hint("merge"), "doc", "left_semi").distinct()
    touched = materialize(touched, "touched")
    discard(shared)
    shards = touched.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.expr("bit_xor(xxhash64(doc))").alias("x"), F.sum(F.expr("xxhash64(doc) >> 24")).alias("s")).filter("c > 1")
    #: Shards with the same members give the same pairs; one of them stays.
    shards = materialize(shards.groupBy("c", "x", "s").agg(F.min("key").alias("key")), "shards")
    members = materialize(touched.join(shards.select("key", "c"), "key"), "members")
    weight = members.groupBy("doc").agg(F.sum("c").alias("w"))
    centre = members.join(weight, "doc").groupBy("key").agg(F.expr("max_by(doc, struct(w, -doc))").alias("centre"))
    needed = docs.withColumnRenamed("doc_id", "doc").join(members.select("doc").distinct().hint("merge"), "doc", "left_semi")
    texts = materialize(needed.mapInArrow(partial(_texts, k=k), "doc long, n long, vec binary, size long, z binary"), "texts")
    placed = materialize(members.join(centre, "key").withColumn("blocks", F.ceil(F.col("c") / block)), "placed")
    discard(touched, members)

    points = placed.join(texts.select("doc", "n", "vec"), "doc")
    blocks = points.select("key", "doc", "n", "vec", F.expr("doc = centre").alias("centre"), F.explode(F.expr("if(doc = centre, sequence(0L, blocks - 1), array(pmod(xxhash64(doc), blocks)))")).alias("block"))
    searched = blocks.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(partial(_best, num=num, den=den), "a long, b long")
    pairs = materialize(searched.distinct(), "pairs")
    linked = materialize(verify(pairs, texts, k, num, den), "linked")
    first = materialize(components(linked), "first")
    discard(pairs)

    #: Shards whose points are still in several components.
    labelled = placed.join(first.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("component", "doc"))
    split = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.expr("max_by(label, struct(size, -label))").alias("major"), (F.sum("size") - F.max("size")).alias("minor")).filter("labels > 1")
    #: Two points have met in the first search; larger shards have pairs that have not.
    split = split.join(shards.filter("c > 2").select("key", "c"), "key").select("key", "major", F.ceil(F.col("minor") / block).alias("parts"), F.ceil(F.col("c") / (4 * block)).alias("tiles"))
    rest = labelled.select("key", "doc", "label").join(split, "key").withColumn("home", F.expr("if(label = major, -1L, pmod(xxhash64(doc), parts))"))
    rest = rest.withColumn("block", F.explode(F.expr("sequence(0L, parts - 1)"))).withColumn("own", F.expr("home = block"))
    #: A block's own points meet all others; the others are cut into tiles of bounded size.
    tile = F.when(F.col("own"), F.expr("sequence(0L, tiles - 1)")).otherwise(F.array(F.expr("pmod(xxhash64(doc, 7), tiles)")))
    rest = rest.select("key", "doc", "label", "own", "block", F.explode(tile).alias("tile")).withColumn("block", F.expr("block * 1000003L + tile")).join(texts.select("doc", "n", "vec"), "doc")
    crossing = rest.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(partial(_crossing, num=num, den=den), "key long, block long, doc long, label long, own boolean")
    crossing = materialize(crossing, "crossing")
    more = crossing.join(texts, "doc").repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(partial(_across, k=k, num=num, den=den), "a long, b long")
    more = materialize(more.distinct(), "more")
    final = components(linked.union(more)).withColumnRenamed("node", "rep")
    discard(shards, texts, placed, linked, first, crossing, more)

    out = sets.join(classes, ["n", "s1", "s2"], "left").join(final, "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class, one row an id.

    Of rows that repeat an id the one with the smallest text stays (null last,
    further ties by all columns).  Rows with a null id stay, all of them.
    Columns stay as they are.
    """
    kept = ngram_components(docs, id_col, text_col, k, num, den).filter("doc_id = component_id").select(F.col("doc_id").alias("_kept"))
    key, text, own = F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = docs.filter(key.isNotNull())
    if not one.groupBy(key).count().filter("count > 1").isEmpty():
        one = one.groupBy(key.alias("_id")).agg(F.min_by(own, F.struct(text.isNull(), text, F.to_json(own))).alias("_row")).select("_row.*")
    return one.join(kept, key == F.col("_kept"), "left_semi").union(docs.filter(key.isNull()))
