"""Operator 6: packing documents into training windows by the sum-of-squares rule.

Each document is encoded, closed by an end id and cut into full windows and a rest. The rest goes, at once and for good, to
the fill level that makes the sum of squares of the numbers of partly filled windows at each level least; the level array
holds those numbers. When a partition ends, its open windows stay as they were placed, the fullest first, and those that lack
more than a hundredth are filled up from the emptiest ones: with their pieces as they are where these fit, else with a piece
cut to fit. So cuts fall on the few pieces that are moved, and one window a partition is short by more at most.

Every partition packs its own rows: there is no shuffle, and the state is the level array and the open windows. Sequence ids
are the partition's number times 2**32 plus a running number, so they never clash and a repeated task gives the same ones.

Edge cases: a null or empty text is the end id alone; equal rows are packed apart; an empty table gives no rows; a document
of any length is cut into windows as its ids come; extra columns are left out of the result.
"""

from __future__ import annotations

import functools
from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Recent, emitted, trimmed

#: Characters for which str.lower and str.split do just what the tokenizer's own normaliser and splitter do; all others go
#: through the library as whole texts.
_OTHER = regex.compile(r"[^\x00-\x1b\x20-ɏ‐-‧‰-⁞€]")
#: The tokenizer's words within a chunk: its own pattern.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Chunks, and words of chunks, that are at hand with their ids; as many may be kept from before.
_CHUNKS, _WORDS = 200_000, 100_000


def _plain(text: str) -> bool:
    if text.isascii():  # a few quick scans instead of a search
        return not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text)
    return not _OTHER.search(text)


class Chunks:
    """Ids of white-space-free chunks, found by the tokenizers library once each. Its splitter never joins chunks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known, self.word = Recent(_CHUNKS), Recent(_WORDS)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _learn(self, new: list[str]) -> None:
        """The ids of unknown chunks: their words in one text each 1000, whose ids are cut after each end-of-word token."""
        alone, several = [], []
        for chunk in new:
            (alone if chunk.isalpha() else several).append(chunk)
        split = [_WORD.findall(chunk) for chunk in several]
        words = self.word.unknown(set(alone).union(*split))
        table = self.word.hand
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cuts) == len(some) and cuts[-1] == 4 * len(ids):
                joined = ids.tobytes()
                table.update(zip(some, map(joined.__getitem__, map(slice, [0, *cuts], cuts)), strict=False))
            else:
                table.update(zip(some, self._encode(some), strict=True))
        get = table.__getitem__
        self.known.hand.update(zip(alone, map(get, alone), strict=True))
        self.known.hand.update((chunk, b"".join(map(get, ws))) for chunk, ws in zip(several, split, strict=True))

    def forget(self) -> None:
        self.known.clear()
        self.word.clear()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        split: list[list[str] | None] = [[] if not t else t.lower().split() if _plain(t) else None for t in texts]
        if new := self.known.unknown(set().union(*filter(None, split))):
            self._learn(new)
        get = self.known.hand.__getitem__
        return [b"".join(map(get, s)) if s is not None else self._encode([t])[0] for t, s in zip(texts, split, strict=True)]


@functools.lru_cache(maxsize=2)
def chunks(path: str) -> Chunks:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task has one core
    return Chunks(path)


class Packer:
    """Sum-of-squares placing of pieces (any objects with a length) into windows of `size`."""

    def __init__(self, size: int):
        self.size = size
        self.level = np.zeros(size + 1, dtype=np.int64)  # level[f]: partly filled windows that hold f tokens
        self.open: dict[int, list[list]] = {}

    def place(self, piece, length: int) -> list | None:
        """Puts a piece of 1 to `size` tokens where the sum of squares grows least; returns the window if it is full."""
        size, level = self.size, self.level
        best = 0  # a fresh window
        if length < size:
            # from fill f to f + length: one window fewer at f, one more at f + length; a full window counts nowhere
            now, then = level[1 : size - length + 1], level[1 + length : size + 1]
            change = np.where(now > 0, 2 - 2 * now + 2 * then, np.iinfo(np.int64).max)
            change[-1] -= 1 if now[-1] > 0 else 0
            at = len(change) - 1 - int(change[::-1].argmin())  # the fullest of equals
            if change[at] <= 2 * level[length] + 1:
                best = at + 1
        if best:
            window = self.open[best].pop()
            level[best] -= 1
        else:
            window = []
        window.append(piece)
        fill = best + length
        if fill == size:
            return window
        level[fill] += 1
        self.open.setdefault(fill, []).append(window)
        return None

    def rest(self) -> list[tuple[int, list]]:
        """The open windows with their fill, fullest first; none stays."""
        left = [(fill, w) for fill in sorted(self.open, reverse=True) for w in self.open[fill]]
        self.open.clear()
        self.level[:] = 0
        return left


Piece = tuple[int, int, bytes, int]  # doc, start, ids, doc_tokens


def filled(rest: list[tuple[int, list[Piece]]], size: int, spare: int) -> Iterator[list[Piece]]:
    """Windows from open ones, fullest first: each with at most `spare` tokens to go, but the last.

    The emptiest windows give their pieces up. A gap takes the longest that fits until none does; if more than `spare` is
    left, the longest of all is cut to fit.
    """
    left = deque(rest)
    pool: list[Piece] = []  # by length
    length = lambda piece: len(piece[2]) // 4
    while left or pool:
        fill, window = left.popleft() if left else (0, [])
        window = list(window)
        while size - fill > spare and (pool or left):
            if not pool:
                for piece in left.pop()[1]:
                    insort(pool, piece, key=length)
            at = bisect_right(pool, size - fill, key=length)
            doc, start, ids, total = pool.pop(at - 1 if at else -1)
            if (over := len(ids) // 4 - (size - fill)) > 0:
                insort(pool, (doc, start + size - fill, ids[-4 * over :], total), key=length)
                ids = ids[: -4 * over]
            window.append((doc, start, ids, total))
            fill += len(ids) // 4
        yield window


def pack_ids(docs: Iterable[tuple[int, bytes]], size: int, first: int) -> Iterator[tuple]:
    """(doc, start, length, ids, doc_tokens, sequence, offset) of documents' ids, sequence numbers from `first` on."""
    packer, number = Packer(size), first

    def laid(window: list[Piece]) -> Iterator[tuple]:
        nonlocal number
        offset = 0
        for doc, start, ids, total in window:
            yield doc, start, len(ids) // 4, ids, total, number, offset
            offset += len(ids) // 4
        number += 1

    for doc, ids in docs:
        total = len(ids) // 4
        for start in range(0, total, size):
            piece = (doc, start, ids[4 * start : 4 * (start + size)], total)
            if full := packer.place(piece, len(piece[2]) // 4):
                yield from laid(full)
    for window in filled(packer.rest(), size, size // 100):
        yield from laid(window)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    out = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunks(tokenizer_path)

        def encoded() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    part = batch.slice(at, 200)
                    for doc, ids in zip(part.column(0).to_pylist(), coder.ids(part.column(1).to_pylist()), strict=True):
                        yield doc, ids + end

        yield from emitted(pack_ids(encoded(), size, TaskContext.get().partitionId() << 32), out, weight=lambda r: len(r[3]))
        coder.forget()  # the worker lives on
        trimmed()

    chosen = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "key long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long").withColumnRenamed("key", key)
