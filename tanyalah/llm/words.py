"""Whole Arrow columns of texts cut into words and hashed with NumPy, without a Python loop over words.

A word is a run of bytes other than space and U+0009 to U+000D. All functions
work on one block of texts: a byte buffer and the offsets of its texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
SHINGLE = 5

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RANDOM = np.random.Generator(np.random.PCG64(20260101)).integers(0, 1 << 64, 256 + 64, dtype=np.uint64) | np.uint64(1)
_BYTE, _MULTIPLIER, _SHINGLE = _RANDOM[:256], int(_RANDOM[256]), _RANDOM[257 : 257 + SHINGLE]
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers = {m: np.ones(1, np.uint64) for m in (_MULTIPLIER, _INVERSE)}


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows of at most `limit` bytes (or one text), each with its bytes and offsets."""
    buf, at = text_buffer(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, hi, buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        size = max(n, BLOCK_BYTES + 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the given spans of bytes."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _power(_MULTIPLIER, len(buf)), out=total[1:])
    return mix((total[end] - total[start]) * _power(_INVERSE, len(buf) + 1)[start] + (end - start).astype(np.uint64))


def spans(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true cells within each text: start, end, text."""
    n = len(buf)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    before[edges], after[edges - 1] = False, False
    start = np.flatnonzero(inside & ~before)
    return start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(offsets, start, side="right") - 1


def words_of(buf: np.ndarray, offsets: np.ndarray) -> Words:
    start, end, doc = spans(buf, offsets, ~SPACE[buf])
    return Words(start, end, doc, span_hashes(buf, start, end))


def shingles_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every five successive words of a text, at the place of the first, and those places."""
    n = len(words.doc) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.doc[:n] == words.doc[SHINGLE - 1 :])
    total = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        total += words.hash[at + k] * _SHINGLE[k]
    return mix(total), at


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of true cells in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
