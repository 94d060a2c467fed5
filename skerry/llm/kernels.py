"""Numpy kernels over the raw UTF-8 buffers of Arrow string batches.

Everything here works inside one Spark task on a bounded slice of rows: the
operators cut every Arrow batch into slices of about a megabyte of text
(:func:`slices`), so memory doesn't depend on batch or table size.  A single
very long text forms a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, elementwise on uint64."""
    x = np.asarray(x, U64)
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Random multipliers by position within a span, for multilinear hashing.
POSITION = mix64(np.arange(1 << 16, dtype=U64)) | U64(1)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


class Slice(NamedTuple):
    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets) of a string array; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[Slice]:
    """Consecutive ranges of at most ``rows`` rows and ``most`` bytes of text (one row at least)."""
    data, offsets = buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, lo + rows, max(hi, lo + 1))
        yield Slice(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def spans(member: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of True in ``member``, never across a row's border."""
    n = len(member)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, z)
    first = member.copy()
    first[1:] &= ~member[:-1]
    border = offsets[(offsets > 0) & (offsets < n)]
    first[border] = member[border]
    last = member.copy()
    last[:-1] &= ~member[1:]
    last[border - 1] = member[border - 1]
    start = np.flatnonzero(first)
    return Words(start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, side="right") - 1)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return spans(~_SPACE[data], offsets)


def hash_spans(data: np.ndarray, w: Words) -> np.ndarray:
    """64-bit multilinear hash of each span's bytes.

    Two given different spans collide with probability about 2**-56; over V
    distinct spans about V*V/2**57 pairs are expected to.
    """
    if not len(w.start):
        return np.zeros(0, U64)
    length = w.end - w.start
    first = np.cumsum(length) - length
    where = np.repeat(w.start - first, length)
    where += np.arange(len(where))
    at = where - np.repeat(w.start, length)
    with np.errstate(over="ignore"):
        value = (data[where].astype(U64) + U64(1)) * POSITION[at & 0xFFFF]
        return mix64(np.add.reduceat(value, first) + length.astype(U64) * U64(0xD6E8FEB86659FD93))


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights=weights, minlength=n)
