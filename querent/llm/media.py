"""Media columns: texts stored as progressive JPEG, read back as RGB tensors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm import jpeg
from querent.llm.common import chunks, lean
from querent.llm.common import encode as utf8

_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def padded(raw: bytes) -> bytes:
    """The bytes and zeros up to a positive multiple of 64."""
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


@lean
def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, raw = batch.column(0), utf8(batch.column(1).to_pylist())
        for part in chunks(np.array([len(r) + 64 for r in raw]), 4 << 20):
            own = raw[part]
            yield pa.RecordBatch.from_arrays([docs.slice(part.start, len(own)), pa.array([len(r) for r in own], pa.int64()), pa.array([jpeg.encode(padded(r)) for r in own], pa.binary())], schema=_MEDIA)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text as a progressive JPEG.

    Null and empty texts are one block of zeros.  Rows that repeat are stored
    each, a null id stays null, and extra columns are not read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


_TENSORS = pa.schema([("doc_id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary()), ("payload", pa.binary())])


@lean
def _tensors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            coefs, frame = jpeg.decode_coefficients(batch.column(1)[i].as_py())
            rgb = jpeg.rgb_of(coefs, frame)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([rgb.shape[0]], pa.int32()), pa.array([rgb.shape[1]], pa.int32()), pa.array([rgb.tobytes()], pa.binary()), pa.array([jpeg.payload_of(coefs, frame)], pa.binary())], schema=_TENSORS)


def tensors(media: DataFrame) -> DataFrame:
    """(doc_id, height, width, rgb, payload) decoded from (doc_id, media)."""
    return media.select("doc_id", "media").mapInArrow(_tensors, "doc_id long, height int, width int, rgb binary, payload binary")


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def feature_of(rgb: np.ndarray) -> str:
    """Size, channel sums and checksum of the tensor."""
    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist()
    return f"{rgb.shape[0]}x{rgb.shape[1]}:{sums[0]}:{sums[1]}:{sums[2]}:{zlib.crc32(rgb.tobytes()):08x}"


@lean
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            rows = []
            for doc, n, media in zip(*(c.to_pylist() for c in batch.slice(at, 2000).columns), strict=True):
                coefs, frame = jpeg.decode_coefficients(media)
                p = jpeg.payload_of(coefs, frame)
                rows.append((doc, n, len(p), sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), sha256(media).hexdigest(), feature_of(jpeg.rgb_of(coefs, frame))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DIGEST, strict=True)], schema=_DIGEST)


def digest(media: DataFrame) -> DataFrame:
    """What was read back from each stored image: checks, sizes and features."""
    return media.mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
