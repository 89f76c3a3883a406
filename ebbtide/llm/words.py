"""Words of many texts at once, as 64-bit hashes, straight from Arrow buffers.

Spark normalises the text; a task then finds the words of a whole batch with array
operations: a polynomial hash of every prefix of the buffer gives the hash of any stretch
by one subtraction and one product. No Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, functions as F

#: White space as the word contracts define it, for regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that are looked at together, if no single word is longer.
SEGMENT = 1 << 20
#: Bytes of texts that a task works on together, if no single text is longer.
PIECE = 4 << 20
SPACE = 32
_LIMIT = 1 << 64


def normalised(text: Column) -> Column:
    """Lower case; every run of anything but letters, marks and digits is one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "))


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins and ends.

    A null text has no bytes.
    """
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return bytes_, offsets


def spans(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """First row and number of rows of stretches of about ``most`` bytes, ``PIECE`` if none."""
    most = PIECE if most is None else most
    offsets, at = buffer_of(texts)[1], 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = max(to, at + 1)
        yield at, to - at
        at = to


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int | None = None
           ) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in small batches, by the bytes of their texts."""
    for batch in batches:
        for at, n in spans(batch.column(text), most):
            yield batch.slice(at, n)


def _segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of the buffer that end between words."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(end, at + SEGMENT)
        if to < end:
            row = int(np.searchsorted(offsets, to, side="right")) - 1
            if offsets[row] > at:
                to = int(offsets[row])
            else:
                spaces = np.flatnonzero(data[at:to] == SPACE)
                after = np.flatnonzero(data[to:offsets[row + 1]] == SPACE) if not len(spaces) else ()
                to = at + int(spaces[-1]) + 1 if len(spaces) else \
                    to + int(after[0]) + 1 if len(after) else int(offsets[row + 1])
        yield at, to
        at = to


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def segments(texts: pa.Array, prefixes: tuple[int, ...] = ()
             ) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Row number and hash of every space-separated word, in order, stretch by stretch.

    Also, for each length in ``prefixes``, the hash of the word's first so many bytes,
    0 where the word is shorter.
    """
    data, offsets = buffer_of(texts)
    for at, to in _segments(data, offsets):
        piece = data[at:to]
        inside = piece != SPACE
        edge = np.zeros(len(piece) + 1, dtype=bool)
        edge[0] = edge[-1] = True
        edge[offsets[(offsets >= at) & (offsets <= to)] - at] = True
        before = np.concatenate(([False], inside))
        starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
        if not len(starts):
            continue
        ends = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | edge[1:])) + 1
        size = SEGMENT + 1
        while size < len(piece) + 1:
            size *= 2
        up, down = _powers(size)
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[:len(piece)], out=total[1:])
        unshift = down[starts]
        heads = []
        for length in prefixes:
            stop = np.minimum(starts + length, ends)
            head = mixed((total[stop] - total[starts]) * unshift + np.uint64(length))
            heads.append(np.where(ends - starts >= length, head, np.uint64(0)))
        yield (np.searchsorted(offsets, starts + at, side="right") - 1,
               mixed((total[ends] - total[starts]) * unshift), heads)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of every word of all texts."""
    found = [(rows, hashes) for rows, hashes, _ in segments(texts)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([r for r, _ in found]), np.concatenate([h for _, h in found])


def grams(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every run of n words within one text."""
    if len(rows) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = len(rows) - n + 1
    whole = np.flatnonzero(rows[:last] == rows[n - 1:])
    total = np.zeros(len(whole), np.uint64)
    for i in range(n):
        total += hashes[whole + i] * np.uint64(pow(BASE, i + 1, _LIMIT))
    return whole, mixed(total)


def first_words(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """For each row, the index of its first word; one more entry ends the last row."""
    return np.searchsorted(rows, np.arange(n_rows + 1))


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)
