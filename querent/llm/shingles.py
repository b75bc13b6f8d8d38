"""Word shingle sets of whole texts as sorted, distinct 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from querent.llm.common import GOLDEN, chunks, encode, mix64, prefix_poly, span_hash

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(raw: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one more at the end).

    A word is a maximal run without bytes 20, 09 to 0D; A-Z count as a-z if ``lower``.
    """
    buf = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
    if lower:
        buf = _LOWER[buf]
    gap = _SPACE[buf]
    start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    first = np.cumsum([1, *(len(r) + 1 for r in raw)])
    return span_hash(prefix_poly(buf), start, end), np.searchsorted(start, first)


def sets_of(texts: list[str | None], k: int, chunk_bytes: int = 1 << 20) -> Iterator[np.ndarray]:
    """The shingle set of each text, in order.

    Fewer words than k: the whole sequence is the one shingle.  No words: empty.
    """
    raw = encode(texts)
    for part in chunks(np.array([len(r) + 1 for r in raw]), chunk_bytes):
        words, at = word_hashes(raw[part])
        grams = words.copy() if k == 1 else words[: max(0, len(words) - k + 1)].copy()
        for j in range(1, k):
            grams = mix64(grams * GOLDEN + words[j : j + len(grams)])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                h = words[a : a + 1]
                for j in range(a + 1, b):
                    h = mix64(h * GOLDEN + words[j : j + 1])
                yield mix64(h + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))
