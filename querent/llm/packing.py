"""Sum-of-squares online packing of tokenised documents into fixed windows.

Every document is tokenised once, cut into full windows and one remainder, and
each piece is placed when it arrives.  ``levels[h]`` counts the open windows
filled to h; a piece of size s goes to the level that makes the sum of squared
counts smallest, which keeps the levels even and so leaves a fitting window for
most sizes to come.

Placement runs inside each task, on its own rows.  Pieces in windows that are
still open at the end of a task are few; they are dealt to as many tasks as
their number asks for and packed again, largest first.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import chunks, lean, materialize, text_bytes

END_ID = 1

#: Fixed value: how the vocabulary file splits words, for the characters below; line feeds part the words.
_PIECE = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºà-öø-ÿß]+|[0-9²³¹¼½¾]|[^a-zªµºà-öø-ÿß0-9²³¹¼½¾\n]+")
_EASY = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Numbers(dict):
    """Numbers strings as they are first looked up; ``fresh`` holds those not learned yet."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n

    def of(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

    def first(self, n: int) -> _Numbers:
        """The ``n`` strings that came first; common ones are among them."""
        out = _Numbers()
        out.update(islice(self.items(), n))
        return out


class _Runs:
    """Runs of ids one after the other, in one growing array."""

    def __init__(self) -> None:
        self.flat, self.at, self.n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def extend(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        begin, more = int(self.at[self.n]), len(sizes)
        while begin + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + more + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[begin : begin + len(ids)] = ids
        self.at[self.n + 1 : self.n + more + 1] = begin + np.cumsum(sizes)
        self.n += more

    def first(self, n: int) -> _Runs:
        out, n = _Runs(), min(n, self.n)
        out.extend(self.flat[: self.at[n]], np.diff(self.at[: n + 1]))
        return out

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of these numbers in a row, and where each ends there."""
        first = self.at[which]
        size = self.at[which + 1] - first
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return self.flat[np.repeat(first - (end - size), size) + np.arange(total)], end


class WordEncoder:
    """Ids of whole texts, equal to ``tokenizers``' but with a memo of words.

    White space always separates tokens in this vocabulary, so a text's ids are
    its words' ids in a row.  Texts with characters for which this is not shown
    by the two tables above, or with a special token's name, take the library's
    own path.  Beyond ``memo`` words or pieces, a memo keeps the quarter that came first.
    """

    def __init__(self, path: str, memo: int = 250_000):
        from tokenizers import Tokenizer

        self.full, self.most = Tokenizer.from_file(path), memo
        self.model, self.alphabet = self.full.model, _byte_chars()
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.words, self.word_ids = _Numbers(), _Runs()
        self.pieces, self.piece_ids = _Numbers(), _Runs()

    def _trim(self, most: int) -> None:
        """Memos of over ``most`` strings keep those that came first."""
        few = self.most // 4
        if len(self.words) > most:
            self.words, self.word_ids = self.words.first(few), self.word_ids.first(few)
        if len(self.pieces) > most:
            self.pieces, self.piece_ids = self.pieces.first(few), self.piece_ids.first(few)

    def rest(self) -> None:
        """Between tasks, small memos are kept."""
        self._trim(self.most // 4)

    def _learn(self) -> None:
        """Ids of the fresh words: cut into pieces, all in one pass, and the pieces' ids in a row."""
        found = _PIECE.findall("\n".join([*self.words.fresh, ""]))
        self.words.fresh.clear()
        which = self.pieces.of(found)
        new = [[] if p == "\n" else [t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.alphabet))] for p in self.pieces.fresh]
        self.pieces.fresh.clear()
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        self.piece_ids.extend(np.fromiter(chain.from_iterable(new), np.uint32, int(sizes.sum())), sizes)
        ids, end = self.piece_ids.take(which)
        ends = end[which == self.pieces["\n"]]
        self.word_ids.extend(ids, np.diff(ends, prepend=0))

    def _easy(self, text: str) -> bool:
        try:
            return not text.encode("latin-1").translate(None, _EASY) and not any(s in text for s in self.special)
        except UnicodeEncodeError:
            return False

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        self._trim(self.most)
        out: list[np.ndarray | None] = [None] * len(texts)
        hard = [i for i, t in enumerate(texts) if not self._easy(t)]
        for i, e in zip(hard, self.full.encode_batch([texts[i] for i in hard], add_special_tokens=False) if hard else [], strict=True):
            out[i] = np.array(e.ids, np.uint32)
        easy = [i for i in range(len(texts)) if out[i] is None]
        words = [texts[i].lower().split() for i in easy]
        which = self.words.of(list(chain.from_iterable(words)))
        if self.words.fresh:
            self._learn()
        ids, end = self.word_ids.take(which)
        at = np.concatenate([[0], end])[np.cumsum([0, *map(len, words)])]
        for i, a, b in zip(easy, at[:-1].tolist(), at[1:].tolist(), strict=True):
            out[i] = ids[a:b]
        return out  # type: ignore[return-value]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class SumOfSquares:
    """Open windows by fill level, and the rule that picks one for a piece."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next = capacity, base
        self.levels = np.zeros(capacity + 1, np.int64)
        self.windows: list[list[tuple[int, list]]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int, item: tuple) -> tuple[int, list] | None:
        """Put the item into a window; a window that is now full comes back."""
        cap, n = self.capacity, self.levels
        best, level = 2 * int(n[size]) + 1 if size < cap else 0, 0
        if size < cap:
            cost = 2 * (n[size + 1 : cap + 1] - n[1 : cap - size + 1]) + 2
            cost[-1] -= 1  # a full window leaves the sum
            cost[n[1 : cap - size + 1] == 0] = np.iinfo(np.int64).max
            at = len(cost) - 1 - int(cost[::-1].argmin())
            if cost[at] <= best:
                level = at + 1
        if level:
            window, items = self.windows[level].pop()
            n[level] -= 1
        else:
            window, items = self.next, []
            self.next += 1
        items.append((*item, window, level))
        if level + size == cap:
            return window, items
        self.windows[level + size].append((window, items))
        n[level + size] += 1
        return None

    def open(self) -> Iterator[tuple[int, list]]:
        for level in self.windows:
            yield from level


_PLACED = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("full", pa.bool_())])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, full boolean"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PLACED, strict=True)], schema=_PLACED)


def _settle(pieces: Iterator[tuple], capacity: int, base: int) -> Iterator[pa.RecordBatch]:
    packer, rows = SumOfSquares(capacity, base), []
    for item in pieces:
        if done := packer.place(item[2], item):
            rows += [(*x, True) for x in done[1]]
            if len(rows) >= 10_000:
                yield _batch(rows)
                rows = []
    rows += [(*x, False) for _, items in packer.open() for x in items]
    if rows:
        yield _batch(rows)


def cut(doc: int | None, ids: np.ndarray, capacity: int) -> Iterator[tuple]:
    """(doc_id, start, length, crc32, doc_tokens) of a document's pieces."""
    whole = np.append(ids, np.uint32(END_ID)).astype("<u4")
    for start in range(0, len(whole), capacity):
        part = whole[start : start + capacity]
        yield doc, start, len(part), zlib.crc32(part.tobytes()), len(whole)


@lean
def _pack(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    def pieces() -> Iterator[tuple]:
        enc = encoder(path)
        for batch in batches:
            for part in chunks(text_bytes(batch.column(1)) + 1, 1 << 20):
                docs, texts = (batch.column(i).slice(part.start, part.stop - part.start).to_pylist() for i in (0, 1))
                for doc, ids in zip(docs, enc.encode([t or "" for t in texts]), strict=True):
                    yield from cut(doc, ids, capacity)
        enc.rest()

    yield from _settle(pieces(), capacity, TaskContext.get().partitionId() << 32)


@lean
def _repack(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    rows = (tuple(x) for batch in batches for x in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
    yield from _settle(rows, capacity, 1 << 61 | TaskContext.get().partitionId() << 32)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, group: int = 40_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their window and place in it.

    Null and empty texts are the end id alone.  Rows that repeat are packed as
    often as they occur; a null id stays null.  Extra columns are not read.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = materialize(rows.mapInArrow(partial(_pack, path=path, capacity=capacity), _DDL), "packed")
    rest = first.filter("NOT full")
    tasks = -(-rest.count() // group)
    if tasks > 0:
        again = rest.repartition(tasks, "doc_id", "start").sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32")
        first = first.filter("full").union(again.mapInArrow(partial(_repack, capacity=capacity), _DDL))
    return first.drop("full")
