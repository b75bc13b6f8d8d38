"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and character
n-grams; a softmax layer on the average gives the class.  Vectors and layer are
trained together by stochastic gradient descent in numpy, on a bounded sample
of labelled rows.  For two classes the score of a text is linear in its
features, so scoring sums one number per feature: the table is ``buckets``
floats, whatever the corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import GOLDEN, chunks, encode, lean, mix64, powers, prefix_poly, text_bytes
from querent.llm.shingles import word_hashes

GRAMS = (2, 4)
#: Bytes of text whose features are made at a time; a longer text is whole.
CHUNK = 1 << 18


@dataclass(frozen=True)
class Model:
    bits: int
    weight: np.ndarray  # one logit per bucket
    bias: float


def spans(raw: list[bytes], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, first, last) for each kind of feature; text i has buckets[first[i]:last[i]]."""
    shift = np.uint64(64 - bits)
    words, at = word_hashes(raw, lower=False)
    yield (words >> shift).astype(np.int64), at[:-1], at[1:]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    starts = ends - np.array([len(r) for r in raw])
    p = prefix_poly(buf)
    _, down = powers(len(p))
    for n in GRAMS:
        if len(buf) >= n:
            h = mix64((p[n:] - p[:-n]) * down[: len(p) - n] + np.array([n], np.uint64) * GOLDEN)
        else:
            h = np.zeros(0, np.uint64)
        yield (h >> shift).astype(np.int64), np.minimum(starts, len(h)), np.clip(ends - n + 1, np.minimum(starts, len(h)), len(h))


@lean
def _bags(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, rest = batch.column(1), [batch.column(0), batch.column(2)]
        for part in chunks(text_bytes(texts) + 1, CHUNK):
            kinds = list(spans(encode(texts.slice(part.start, part.stop - part.start).to_pylist()), bits))
            ids, counts = [], []
            for i in range(part.stop - part.start):
                u, c = np.unique(np.concatenate([b[f[i] : l[i]] for b, f, l in kinds]), return_counts=True)
                ids.append(u.astype(np.int32))
                counts.append(c.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(x.slice(part.start, part.stop - part.start) for x in rest), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "label", "ids", "counts"])


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], bits: int, dim: int = 16, epochs: int = 12, rate: float = 0.4, seed: int = 7) -> Model:
    """Stochastic gradient descent, one document a step, linearly falling rate."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((1 << bits, dim)) - 0.5) / dim).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    step, steps = 0, max(1, epochs * len(bags))
    for _ in range(epochs):
        for i in rng.permutation(len(bags)).tolist():
            y, ids, counts = bags[i]
            c = (counts / max(1, counts.sum())).astype(np.float32)
            lr, step = np.float32(rate * (1 - step / steps)), step + 1
            hidden = c @ vectors[ids]
            z = hidden @ layer + bias
            e = np.exp(z - z.max())
            g = e / e.sum()
            g[y] -= 1
            back = layer @ g
            layer -= lr * np.outer(hidden, g)
            bias -= lr * g
            #: A feature's share of the average is small; its step is scaled up by the text's features.
            vectors[ids] -= (lr * np.minimum(1, c * len(ids)))[:, None] * back
    return Model(bits, (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def scores(model: Model, raw: list[bytes]) -> np.ndarray:
    total, count = np.zeros(len(raw)), np.zeros(len(raw))
    for buckets, first, last in spans(raw, model.bits):
        sums = np.concatenate([[0.0], np.cumsum(model.weight[buckets], dtype=np.float64)])
        total += sums[last] - sums[first]
        count += last - first
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + model.bias)))


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


@lean
def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, docs = batch.column(1), batch.column(0)
        for part in chunks(text_bytes(texts) + 1, CHUNK):
            n = part.stop - part.start
            yield pa.RecordBatch.from_arrays([docs.slice(part.start, n), pa.array(scores(model, encode(texts.slice(part.start, n).to_pylist())))], schema=_SCORED)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, bits: int = 16) -> Model:
    """A model from at most ``most`` labelled rows outside the held-out fold.

    The rows with the smallest hashes of doc_id are taken, so the sample does
    not depend on order.  Rows with a null id, label or text, and labels other
    than 0 and 1, are passed over; of repeated labels the smallest counts.
    Without any row the model scores every text 0.5.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
    bags = rows.mapInArrow(partial(_bags, bits=bits), "doc_id long, label int, ids array<int>, counts array<int>")
    got = bags.toArrow().sort_by([("doc_id", "ascending")])
    kinds, ids, counts = got.column("label").to_pylist(), got.column("ids").combine_chunks(), got.column("counts").combine_chunks()
    del got  # the driver holds the sample once
    at, flat, many = ids.offsets.to_numpy(), ids.values.to_numpy(), counts.values.to_numpy()
    return train([(y, flat[a:b], many[a:b]) for y, a, b in zip(kinds, at[:-1].tolist(), at[1:].tolist(), strict=True)], bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; null and empty texts get the class prior.

    Rows that repeat are scored each; a null id stays null.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(partial(_score, model=model), "doc_id long, score double")


@lean
def _accepted(batches: Iterator[pa.RecordBatch], model: Model, least: float, column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(column)
        keep = [scores(model, encode(texts.slice(part.start, part.stop - part.start).to_pylist())) >= least for part in chunks(text_bytes(texts) + 1, CHUNK)]
        if keep:
            yield batch.filter(pa.array(np.concatenate(keep)))


def accept(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows whose score reaches ``least``, with all their columns, in one pass.

    Null and empty texts have the class prior as their score.
    """
    return docs.mapInArrow(partial(_accepted, model=model, least=least, column=docs.columns.index(text_col)), docs.schema)
