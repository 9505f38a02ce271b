"""Vectorised words and shingles over Arrow text columns.

A word is a maximal run of ASCII letters and digits and of non-ASCII characters; A-Z are lower-cased first. In UTF-8
every byte of a non-ASCII character is at least 0x80, so runs can be found on bytes. Words and shingles are 64-bit
hashes: two different ones agree with a chance of 2**-64 or so. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_LANE = _RNG.integers(1, 2**63, 64, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_SEGMENT = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=_U)
    p[0] = 1
    return np.cumprod(p, dtype=_U)


_POW = _powers(_BASE, _SEGMENT + 1)
_INV = _powers(pow(_BASE, -1, 2**64), _SEGMENT + 1)

#: Byte to lower-case byte, 0 for a separator.
LOWER = np.zeros(256, dtype=np.uint8)
LOWER[0x30:0x3A] = np.arange(0x30, 0x3A)
LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
LOWER[0x80:] = np.arange(0x80, 0x100)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (start, stop, bytes, offsets) of about max_bytes; a longer text is a block of its own."""
    data, off = utf8(column)
    start, n = 0, len(off) - 1
    while start < n:
        stop = int(np.searchsorted(off, off[start] + max_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop, data[off[start] : off[stop]], off[start : stop + 1] - off[start]
        start = stop


@dataclass
class Words:
    """start, end: byte positions of each word; doc: its row; ptr: rows' first words and, last, the number of words."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    ptr: np.ndarray
    hash: np.ndarray
    prefix: dict[int, np.ndarray]

    def text(self, i: int) -> str:
        return self.low[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def words(data: np.ndarray, off: np.ndarray, prefixes: tuple[int, ...] = ()) -> Words:
    """Words of concatenated texts. prefixes: also hash the first so many bytes of each word."""
    n, rows = len(data), len(off) - 1
    low = LOWER[data]
    inside = low != 0
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True
    first, last = inside.copy(), inside.copy()
    if n > 1:
        first[1:] &= ~inside[:-1] | cut[1:n]
        last[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(off, start, side="right") - 1
    ptr = np.searchsorted(doc, np.arange(rows + 1))
    h = np.empty(len(start), dtype=_U)
    pre = {k: np.empty(len(start), dtype=_U) for k in prefixes}
    i = 0
    while i < len(start):
        j = max(int(np.searchsorted(end, start[i] + _SEGMENT, side="right")), i + 1)
        a, b = int(start[i]), int(end[j - 1])
        pw, inv = (_POW, _INV) if b - a <= _SEGMENT else (_powers(_BASE, b - a + 1), _powers(pow(_BASE, -1, 2**64), b - a + 1))
        c = np.zeros(b - a + 1, dtype=_U)
        np.cumsum(_BYTE[low[a:b]] * pw[: b - a], dtype=_U, out=c[1:])
        s, e = start[i:j] - a, end[i:j] - a
        h[i:j] = (c[e] - c[s]) * inv[s]
        for k in prefixes:
            pre[k][i:j] = (c[np.minimum(s + k, e)] - c[s]) * inv[s]
        i = j
    return Words(low, start, end, doc, ptr, mix(h), {k: mix(v + _U(k)) for k, v in pre.items()})


def word_count(w: Words) -> np.ndarray:
    return np.diff(w.ptr)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of k words, repeats included. A text of fewer words, but not none, is one shingle of all of them."""
    n = len(w.hash)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    at, stop = np.arange(n), w.ptr[1:][w.doc]
    pad = np.concatenate([w.hash, np.zeros(k, _U)])
    acc = np.zeros(n, _U)
    for j in range(k):
        acc += np.where(at + j < stop, pad[j : j + n], _U(0)) * _LANE[j]
    keep = (at + k <= stop) | (at == w.ptr[:-1][w.doc])
    return mix(acc[keep]), w.doc[keep]
