"""Exact repeated substrings with a logarithmic family of suffix arrays.

A byte is removed when a string of ``length`` bytes that covers it also starts
anywhere else, in any document or at another place of the same one.  The same
index also runs over words instead of bytes (``repeated_passages``); a unit is a
byte there or the hash of a word.

1. *Anchors.*  A window is a string of ``length`` units.  Its anchor is its
   ``gram``-unit substring of least hash (leftmost of equals), so equal windows
   have equal anchors at equal offsets.  The windows of one anchor are
   neighbours; the units they cover are the anchor's context, some 550 bytes
   for every 150 of text.
2. *Collapse.*  Anchors that occur once are dropped.  Equal contexts are counted
   and leave one entry, so copies cost one entry, not one each; an entry counted
   twice or more repeats as a whole.
3. *Index family.*  The remaining entries are dealt and sorted by anchor.  Each
   task takes them in batches: a batch gets suffix arrays (right contexts, and left
   contexts read backwards) with longest common prefixes, is merge-scanned with
   itself and every level for long matches, and levels of equal size merge.  Once
   a family is large, it ends where an anchor does, so memory does not grow with
   what a task is dealt.
4. *Hot anchors.*  An anchor with more than ``hot`` different contexts would
   make one task too large.  Its windows are dealt singly by a 128-bit digest
   and counted, which combines before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querent.llm.common import discard, encode, lean, materialize, mix64, powers, prefix_poly, text_parts
from querent.llm.shingles import word_hashes


def sliding_argmin(v: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the least value in v[i:i + width], for each i.

    Sparse doubling: minima of power-of-two spans, the last overlapped.
    """
    at, span = np.arange(len(v)), 1
    while span * 2 <= width:
        right = at[span:]
        left = at[: len(right)]
        at = np.where(v[right] < v[left], right, left)
        span *= 2
    left, right = at[: len(v) - width + 1], at[width - span :][: len(v) - width + 1]
    return np.where(v[right] < v[left], right, left)


def values_of(texts: list[str | None], words: bool) -> list[np.ndarray]:
    """The units of each text: its bytes, or the hashes of its words."""
    raw = encode(texts)
    if not words:
        return [np.frombuffer(t, np.uint8) for t in raw]
    hashes, at = word_hashes(raw)
    return [hashes[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def anchors(values: list[np.ndarray], length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, hash, position, first window, last window) arrays of each long enough text."""
    buf = np.concatenate(values) if values else np.zeros(0, np.uint8)
    p = prefix_poly(buf)
    n = len(buf) - gram + 1
    if n <= 0:
        return
    _, down = powers(len(p))
    h = mix64((p[gram:] - p[:-gram]) * down[:n])
    start = 0
    for i, t in enumerate(values):
        if len(t) >= length:
            v = h[start : start + len(t) - gram + 1]
            least = sliding_argmin(v, length - gram + 1)
            first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            last = np.concatenate([first[1:] - 1, [len(least) - 1]])
            at = least[first]
            yield i, v[at], at, first, last
        start += len(t)


_ANCHORS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("a", pa.int64()), ("x", pa.binary()), ("pos", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


@lean
def _anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int, words: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, keys, start = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
        for texts in text_parts(batch, 2):
            values = values_of(texts, words)
            rows: list[list] = [[] for _ in _ANCHORS]
            for i, h, at, lo, hi in anchors(values, length, gram):
                t, unit = values[i].tobytes(), values[i].itemsize
                rows[0] += [docs[start + i]] * len(h)
                rows[1] += [keys[start + i]] * len(h)
                rows[3] += [hashlib.blake2b(t[a * unit : (b + length) * unit], digest_size=16, key=int(p - a).to_bytes(4, "little")).digest() for a, b, p in zip(lo.tolist(), hi.tolist(), at.tolist(), strict=True)]
                for k, c in ((2, h.astype(np.int64)), (4, at), (5, lo), (6, hi)):
                    rows[k].append(c)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(r) if k in (2, 4, 5, 6) else r, f.type) for k, (r, f) in enumerate(zip(rows, _ANCHORS, strict=True))], schema=_ANCHORS)
            start += len(texts)


class Level:
    """Entries of one index level, with both suffix orders and their common prefixes.

    An entry is an anchor's context: ``left`` bytes before the anchor reversed,
    ``right`` bytes from it on, and the anchor's offsets lo..hi in its windows.
    """

    def __init__(self, keys: list[int], left: list[bytes], right: list[bytes], lo: np.ndarray, hi: np.ndarray, tags: list, found: np.ndarray, by_left: list[int] | None = None, by_right: list[int] | None = None):
        self.keys, self.left, self.right, self.lo, self.hi, self.tags, self.found = keys, left, right, lo, hi, tags, found
        n = range(len(keys))
        #: sorted() merges the runs it finds, so joined orders of two levels cost a merge.
        self.by_left = sorted(by_left or n, key=lambda i: (keys[i], left[i]))
        self.by_right = sorted(by_right or n, key=lambda i: (keys[i], right[i]))

    def __len__(self) -> int:
        return len(self.keys)

    def part(self, wanted: set[int]) -> Level:
        """The entries whose anchors are wanted, in the same orders."""
        keep = [i for i, k in enumerate(self.keys) if k in wanted]
        new = {old: i for i, old in enumerate(keep)}
        out = Level([self.keys[i] for i in keep], [self.left[i] for i in keep], [self.right[i] for i in keep], self.lo[keep], self.hi[keep], [self.tags[i] for i in keep], self.found[keep], [new[i] for i in self.by_left if i in new], [new[i] for i in self.by_right if i in new])
        out.source = keep  # type: ignore[attr-defined]
        return out

    def merged(self, other: Level) -> Level:
        n = len(self)
        return Level(self.keys + other.keys, self.left + other.left, self.right + other.right, np.concatenate([self.lo, other.lo]), np.concatenate([self.hi, other.hi]), self.tags + other.tags, np.concatenate([self.found, other.found]), self.by_left + [n + i for i in other.by_left], self.by_right + [n + i for i in other.by_right])

    def _common(self, order: list[int], side: list[bytes], width: int, unit: int) -> np.ndarray:
        """Common prefix, in units, of each entry with the one before it in the order; -1 across anchors."""
        width *= unit
        out = np.full(len(order), -1, np.int64)
        for at in range(0, len(order), 8192):
            own = order[max(0, at - 1) : at + 8192]
            size = np.array([len(side[i]) for i in own], np.int64)
            m = np.frombuffer(b"".join(side[i].ljust(width, b"\0") for i in own), np.uint8).reshape(-1, width)
            differ = m[1:] != m[:-1]
            lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
            lcp = np.minimum(lcp, np.minimum(size[1:], size[:-1])) // unit
            key = np.array([self.keys[i] for i in own])
            out[max(1, at) : at + 8192] = np.where(key[1:] == key[:-1], lcp, -1)
        return out

    def scan(self, length: int, unit: int) -> None:
        """Mark, in ``found``, the offsets at which an entry's window also is another entry's.

        At offset o a window is the last o units on the left and the first
        length - o on the right.  Cutting the common prefixes at these lengths
        numbers the classes on either side; windows are equal when both are.
        """
        if len(self) < 2:
            return
        left, right = np.array(self.by_left), np.array(self.by_right)
        lcs = self._common(self.by_left, self.left, max(1, int(self.hi.max())), unit)
        lcp = self._common(self.by_right, self.right, length, unit)
        l_class, r_class = np.empty(len(self), np.int64), np.empty(len(self), np.int64)
        for o in range(int(self.lo.min()), int(self.hi.max()) + 1):
            l_class[left] = np.cumsum(lcs < o)
            r_class[right] = np.cumsum(lcp < length - o)
            own = np.flatnonzero((self.lo <= o) & (o <= self.hi))
            if len(own) < 2:
                continue
            both = l_class[own] * np.int64(len(self) + 1) + r_class[own]
            order = np.argsort(both)
            same = both[order[1:]] == both[order[:-1]]
            hit = np.zeros(len(own), bool)
            hit[order[1:]] |= same
            hit[order[:-1]] |= same
            self.found[own[hit], o] = True


class Family:
    """Levels of doubling size; each new batch is scanned against all of them."""

    def __init__(self, length: int, unit: int):
        self.length, self.unit, self.levels = length, unit, []

    def __len__(self) -> int:
        return sum(map(len, self.levels))

    def add(self, batch: Level) -> None:
        batch.scan(self.length, self.unit)
        wanted = set(batch.keys)
        for level in self.levels:
            part = level.part(wanted)
            if not len(part):
                continue
            both = batch.merged(part)
            both.scan(self.length, self.unit)
            batch.found |= both.found[: len(batch)]
            level.found[part.source] |= both.found[len(batch) :]  # type: ignore[attr-defined]
        while self.levels and len(self.levels[-1]) <= len(batch):
            batch = self.levels.pop().merged(batch)
        self.levels.append(batch)

    def runs(self) -> Iterator[pa.RecordBatch]:
        """The offsets found, as runs."""
        for level in self.levels:
            edge = np.diff(level.found.astype(np.int8), axis=1, prepend=0, append=0)
            row, begin = np.nonzero(edge == 1)
            _, end = np.nonzero(edge == -1)
            for s in range(0, len(row), 20_000):
                r = row[s : s + 20_000].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([level.keys[i] for i in r], pa.int64()), pa.array([level.tags[i] for i in r], pa.binary()), pa.array(begin[s : s + 20_000]), pa.array(end[s : s + 20_000] - 1)], schema=_RUNS)


_RUNS = pa.schema([("a", pa.int64()), ("x", pa.binary()), ("from_offset", pa.int64()), ("to_offset", pa.int64())])


@lean
def _index(batches: Iterator[pa.RecordBatch], length: int, gram: int, unit: int, batch_size: int, most: int) -> Iterator[pa.RecordBatch]:
    family, last = Family(length, unit), None
    for batch in batches:
        for start in range(0, batch.num_rows, batch_size):
            a, x, ctx, before, width = (c.to_pylist() for c in batch.slice(start, batch_size).columns)
            if len(family) >= most and a[0] != last:
                yield from family.runs()
                family = Family(length, unit)
            last, cut = a[-1], [b * unit for b in before]
            hi = np.array(before, np.int64)
            lo = hi - np.array(width, np.int64) + 1
            family.add(Level(a, [c[:b][::-1] for c, b in zip(ctx, cut, strict=True)], [c[b:] for c, b in zip(ctx, cut, strict=True)], lo, hi, x, np.zeros((len(a), length - gram + 1), bool)))
    yield from family.runs()


_CTX = pa.schema([("a", pa.int64()), ("x", pa.binary()), ("ctx", pa.binary()), ("before", pa.int64()), ("width", pa.int64())])


@lean
def _contexts(batches: Iterator[pa.RecordBatch], length: int, words: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start = 0
        for texts in text_parts(batch, 0):
            rows: list[tuple] = []
            for value, items in zip(values_of(texts, words), batch.column(1).slice(start, len(texts)).to_pylist(), strict=True):
                text, unit = value.tobytes(), value.itemsize
                rows += [(i["a"], i["x"], text[i["lo"] * unit : (i["hi"] + length) * unit], i["pos"] - i["lo"], i["hi"] - i["lo"] + 1) for i in items]
            for s in range(0, len(rows), 5_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[s : s + 5_000], strict=True), _CTX, strict=True)], schema=_CTX)
            start += len(texts)


_WINDOWS = pa.schema([("a", pa.int64()), ("x", pa.binary()), ("offset", pa.int64()), ("digest", pa.binary())])


@lean
def _windows(batches: Iterator[pa.RecordBatch], length: int, unit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, x, ctx, before, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            digest = [hashlib.blake2b(ctx[i * unit : (i + length) * unit], digest_size=16).digest() for i in range(width)]
            yield pa.RecordBatch.from_arrays([pa.array([a] * width, pa.int64()), pa.array([x] * width, pa.binary()), pa.array(range(before, before - width, -1), pa.int64()), pa.array(digest, pa.binary())], schema=_WINDOWS)


_KEPT = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


@lean
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 1000):
            part = batch.slice(begin, 1000)
            raw = encode(part.column(2).to_pylist())
            all_spans, kept = [], []
            for text, los, his in zip(raw, part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                spans: list[dict] = []
                if los:
                    lo, hi = np.array(los), np.array(his)
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], np.maximum.accumulate(hi[order])
                    cut = np.concatenate([[True], lo[1:] > hi[:-1]])
                    spans = [{"start": s, "end": e} for s, e in zip(lo[cut].tolist(), hi[np.concatenate([cut[1:], [True]])].tolist(), strict=True)]
                at, out = 0, []
                for s in spans:
                    out.append(text[at : s["start"]])
                    at = s["end"]
                all_spans.append(spans)
                kept.append(b"".join([*out, text[at:]]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(t) for t in raw], pa.int64()), pa.array(all_spans, _KEPT.field("spans").type), pa.array(kept, pa.binary())], schema=_KEPT)


def repeated_spans(docs: DataFrame, length: int, gram: int, words: bool, batch_size: int = 2048, most: int = 32_768, hot: int = 4096) -> DataFrame:
    """(doc_id, row, lo, hi): spans, in units, of windows that also start elsewhere; they may overlap.

    ``docs`` is (doc_id, row, text).  A family of ``most`` entries ends at its next
    new anchor.  The table that comes back is on disk; all others are deleted.
    """
    unit = 8 if words else 1
    every = docs.select("doc_id", "row", "text").mapInArrow(partial(_anchors, length=length, gram=gram, words=words), "doc_id long, row long, a long, x binary, pos long, lo long, hi long")
    every = materialize(every, "anchors")
    again = materialize(every.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a"), "again")
    found = materialize(every.join(again, "a"), "found", heavy=True)
    discard(every, again)

    entries = found.groupBy("a", "x").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "row", "pos", "lo", "hi")).alias("one"))
    entries = materialize(entries, "entries", heavy=True)
    groups = entries.groupBy("a").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1")
    needed = entries.join(groups, "a").select("a", "x", "one.*")
    per_doc = needed.groupBy(F.col("doc_id").alias("id"), F.col("row").alias("key")).agg(F.collect_list(F.struct("a", "x", "pos", "lo", "hi")).alias("items"))
    with_items = docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("key"))).select("text", "items")
    contexts = materialize(with_items.mapInArrow(partial(_contexts, length=length, words=words), "a long, x binary, ctx binary, before long, width long"), "contexts", heavy=True)

    hot_keys = groups.filter(F.col("contexts") > hot).select("a")
    runs = contexts.join(hot_keys, "a", "left_anti").repartition("a").sortWithinPartitions("a").mapInArrow(partial(_index, length=length, gram=gram, unit=unit, batch_size=batch_size, most=most), "a long, x binary, from_offset long, to_offset long")
    windows = contexts.join(hot_keys, "a", "left_semi").mapInArrow(partial(_windows, length=length, unit=unit), "a long, x binary, offset long, digest binary")
    twice = windows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    single = windows.join(twice, "digest").select("a", "x", F.col("offset").alias("from_offset"), F.col("offset").alias("to_offset"))
    runs = materialize(runs.union(single), "runs")

    copies = entries.filter("copies > 1").select("a", "x")
    whole = found.join(copies, ["a", "x"], "left_semi").select("doc_id", "row", "lo", F.expr(f"hi + {length}").alias("hi"))
    alone = entries.filter("copies = 1").select("a", "x", "one.*").join(runs, ["a", "x"]).select("doc_id", "row", F.expr("pos - to_offset").alias("lo"), F.expr(f"pos - from_offset + {length}").alias("hi"))
    spans = materialize(whole.union(alone), "spans", heavy=True)
    discard(found, entries, contexts, runs)
    return spans


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 100, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """Cut every repeated string of ``length`` bytes from all documents.

    Null texts count as empty; texts shorter than ``length`` stay whole.  Every
    row is a document: rows that repeat as a whole repeat all their strings, so
    long ones lose everything in each of the rows.  A null id is an id as any
    other, and texts that share an id are told apart.  Extra columns are not
    read; an empty table gives an empty one.

    Returns doc_id, row (a hash of the text), n_bytes, spans (maximal removed
    runs), kept (bytes).
    """
    docs = _rows(docs, id_col, text_col)
    spans = repeated_spans(docs, length, gram, False, **limits)
    spans = spans.groupBy(F.col("doc_id").alias("id"), F.col("row").alias("key")).agg(F.collect_list(F.struct("lo", "hi")).alias("all")).select("id", "key", F.col("all.lo").alias("los"), F.col("all.hi").alias("his"))
    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("key")), "left")
    return joined.select("doc_id", "row", "text", "los", "his").mapInArrow(_cut, "doc_id long, row long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def repeated_passages(docs: DataFrame, words: int = 51, gram: int = 13, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """(doc_id, row, n_words): words of each text inside passages of ``words`` words or more that also stand elsewhere.

    Words are what ``word_hashes`` takes for them, A-Z as a-z.  ``row`` is the
    hash of the text.  Only documents that have such a passage appear, once.
    """
    spans = repeated_spans(_rows(docs, id_col, text_col), words, gram, True, **limits)
    order = Window.partitionBy("doc_id", "row").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.greatest("lo", F.coalesce(F.max("hi").over(order), F.lit(0)))
    covered = spans.withColumn("new", F.greatest(F.lit(0), F.col("hi") - begin))
    return covered.groupBy("doc_id", "row").agg(F.sum("new").alias("n_words"))
