"""Vectorised text kernels over Arrow string buffers.

A batch of texts is one byte array with document offsets. Words, their 64-bit
hashes and rolling window hashes come from cumulative sums over that array, so
no Python object is made for each word. Work is cut into pieces of whole
documents of about PIECE bytes to bound memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE + 1)
        have = np.full(size, base, dtype=U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 8 * PIECE:
            _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits of 64-bit integers."""
    z = x.astype(U, copy=True)
    z ^= z >> U(30)
    z *= U(0xBF58476D1CE4E5B9)
    z ^= z >> U(27)
    z *= U(0x94D049BB133111EB)
    z ^= z >> U(31)
    return z


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets (int64, from 0) of a string column; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(data: np.ndarray, offs: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of whole documents, about ``most`` bytes each."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * BASE**place, one longer than data."""
    out = np.zeros(len(data) + 1, dtype=U)
    np.multiply(data.astype(U) + U(1), powers(len(data)), out=out[1:])
    np.cumsum(out, out=out)
    return out


def span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, the same wherever the span stands."""
    inverse = powers(len(total), INVERSE)
    return mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(U))


def words(data: np.ndarray, offs: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its
    first word (one longer than the documents)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offs)


def owners(bounds: np.ndarray) -> np.ndarray:
    """The document of each item, from the index of each document's first item."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def windows(values: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k values within one document, and where each
    starts. A document of fewer than k (but any) values gives one run of all."""
    n = len(values)
    total = np.zeros(n + 1, dtype=U)
    np.multiply(values, powers(n) if n else values, out=total[1:])
    np.cumsum(total, out=total)
    count = np.diff(bounds)
    runs = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(count)), runs)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    start = bounds[:-1][owner] + place
    end = start + np.minimum(k, count[owner])
    return span_hash(total, start, end), start
