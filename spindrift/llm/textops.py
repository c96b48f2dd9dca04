"""Vectorised word hashing over Arrow string columns.

A word is a run of ``[^\\x20\\x09-\\x0D]+``.  Everything works on the UTF-8
bytes of many documents at once; documents are taken in slices of a few MB, so
memory does not follow the batch.  Hashes are 64 bit and the same in every
process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import kept

U = np.uint64
_SEED = np.random.Generator(np.random.PCG64(20240229))
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_MUL = _SEED.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
SLICE_BYTES = 2_000_000

_powers: dict[str, np.ndarray] = {}


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n + 1 of each."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = max(n + 1, SLICE_BYTES + 200_000)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, U(base))
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the word."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of len + 1) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    _, off, data = col.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(off, np.int32, n + 1, col.offset * 4).astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `size` bytes, or one document that is larger."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def byte_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """Hashes of the spans start..end of b; with `lower`, A-Z count as a-z."""
    n = len(b)
    up, down = _table(n)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((_LOWER if lower else _BYTE)[b] * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


class Words:
    """Words of documents i..j of a column.

    ``hash``: 64-bit hash by word; ``first``: index of each document's first
    word (len docs + 1); ``start``/``end``: byte positions from ``base``;
    ``offsets``: where documents begin there.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int, lower: bool):
        self.base = int(offsets[i])
        b = data[self.base : int(offsets[j])]
        off = self.offsets = offsets[i : j + 1] - self.base
        n = len(b)
        space = np.empty(n + 1, dtype=bool)
        space[n] = True
        np.take(_SPACE, b, out=space[:n])
        head = np.zeros(n + 1, dtype=bool)
        head[off] = True
        before = np.empty(n + 1, dtype=bool)
        before[0] = True
        before[1:] = space[:-1]
        self.start = np.flatnonzero(~space & (before | head))
        self.end = np.flatnonzero((space | head) & ~before)
        self.hash = byte_hashes(b, self.start, self.end, lower)
        self.first = np.searchsorted(self.start, off)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of k words from each word on, whether they lie in its document)."""
        n = len(self.hash)
        up, down = _table(n)
        total = np.zeros(n + k + 1, dtype=np.uint64)
        np.cumsum(self.hash * up[:n], out=total[1 : n + 1])
        total[n + 1 :] = total[n]
        h = mix((total[k : n + k] - total[:n]) * down[:n] + U(k))
        last = np.repeat(self.first[1:], np.diff(self.first))
        return h, np.arange(n) + k <= last

    def shingles(self, k: int) -> list[np.ndarray]:
        """Sorted distinct k-word shingle hashes by document; shorter texts are one shingle."""
        h, ok = self.windows(k)
        out = []
        for a, z in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            if z - a >= k:
                out.append(np.unique(h[a : z - k + 1]))
            elif z > a:
                whole = U(z - a)
                for x, m in zip(self.hash[a:z], _MUL):
                    whole = whole * m + x
                out.append(mix(np.array([whole], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def words_of(col: pa.Array, lower: bool) -> Iterator[tuple[int, int, Words]]:
    kept("words")
    data, offsets = buffers(col)
    with np.errstate(over="ignore"):
        for i, j in slices(offsets):
            yield i, j, Words(data, offsets, i, j, lower)


def packed(parts: list[np.ndarray], dtype) -> pa.Array:
    return pa.array([np.ascontiguousarray(p, dtype=dtype).tobytes() for p in parts], pa.binary())
