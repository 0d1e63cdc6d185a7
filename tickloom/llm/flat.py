"""Texts of an Arrow batch as one flat byte array, and runs of bytes in it as hashes.

Tokenising operators work on whole blocks of texts at once: a table lookup
gives each byte its class, class changes give the tokens, and differences of a
prefix polynomial hash (modulo 2**64) give each token's hash. Blocks hold about
``BLOCK`` bytes, or one longer text, so memory is bounded by that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
#: An odd base, so that its powers can be inverted modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table yet is kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 1024), base & (2**64 - 1), np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


INVERSE = pow(BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix(buf: np.ndarray, base: int = BASE) -> np.ndarray:
    """C with C[i] = sum of (buf[j] + 1) * base**j over j < i; its length is len(buf) + 1."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + _U(1)) * powers(len(buf), base), out=out[1:])
    return out


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """A hash of buf[start:end] that does not depend on where it stands; c is ``prefix`` by the same base."""
    n = len(c)
    return mix((c[end] - c[start]) * powers(n, pow(base, -1, 2**64))[start] + (end - start).astype(np.uint64) * _U(0x2545F4914F6CDD1D))


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column without nulls into blocks: (first row, end row, bytes, offsets in them)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def runs(cls: np.ndarray, off: np.ndarray, alone: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one class other than 0 that no text boundary cuts: starts, ends, classes. Each byte of class ``alone`` is a run."""
    n = len(cls)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, cls.dtype)
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(cls[1:], cls[:-1], out=edge[1:])
    inner = off[(off > 0) & (off < n)]
    edge[inner] = True
    if alone is not None:
        edge |= cls == alone
    start = np.flatnonzero(edge)
    end = np.append(start[1:], n)
    kind = cls[start]
    keep = kind != 0
    return start[keep], end[keep], kind[keep]


def per_text(start: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bounds: the tokens of text i are start[b[i]:b[i+1]]."""
    return np.searchsorted(start, off)


def segment_sum(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of x[bounds[i]:bounds[i+1]]; empty parts give 0."""
    c = np.concatenate(([0], np.cumsum(x)))
    return c[bounds[1:]] - c[bounds[:-1]]


def gather(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices first[0] .. first[0]+length[0]-1, first[1] .. one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(first - at, length)


class Known:
    """Hashes seen before and the number of each: an open-addressing table, looked up for a whole block at once.

    The caller keeps what belongs to a number in its own arrays and empties
    both when they hold more than it wants.
    """

    def __init__(self) -> None:
        self.count, self.bits = 0, 16
        self.keys, self.rows = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it is new."""
        h = hashes | _U(1)  # 0 marks an empty slot
        mask = np.uint64((1 << self.bits) - 1)
        at = (h >> _U(64 - self.bits)).astype(np.int64)
        key = self.keys[at]
        out = np.where(key == h, self.rows[at], -1)
        todo = np.flatnonzero((key != h) & (key != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & np.int64(mask)
            key = self.keys[at[todo]]
            hit = key == h[todo]
            out[todo[hit]] = self.rows[at[todo[hit]]]
            todo = todo[~hit & (key != 0)]
        return out

    def distinct_new(self, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where each new hash (row -1) first stands."""
        new = np.flatnonzero(rows < 0)
        return new[np.sort(np.unique(hashes[new] | _U(1), return_index=True)[1])]

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """Number distinct new hashes from ``count`` on."""
        rows = np.arange(self.count, self.count + len(hashes))
        self.count += len(hashes)
        h = hashes | _U(1)
        if 2 * self.count > len(self.keys):
            old = self.keys != 0
            h, rows = np.concatenate((self.keys[old], h)), np.concatenate((self.rows[old], rows))
            while 2 * self.count > 1 << self.bits:
                self.bits += 1
            self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int64)
        at = (h >> _U(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            self.keys[at[free]] = h[free]  # of several for one slot the last stays
            self.rows[at[free]] = rows[free]
            todo = todo[self.keys[at[todo]] != h[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return np.arange(self.count - len(hashes), self.count)


class Store:
    """Arrays that grow by doubling: a flat list of values, and where each row's begin and how many they are."""

    def __init__(self, dtype) -> None:
        self.flat, self.first, self.size = np.zeros(1 << 16, dtype), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.count = 0

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.count + len(size) > len(self.first):
            self.first, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        self.first[self.count : self.count + len(size)] = self.used + np.cumsum(size) - size
        self.size[self.count : self.count + len(size)] = size
        self.used += len(flat)
        self.count += len(size)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these rows one after the other, and how many each has."""
        size = self.size[rows]
        return self.flat[gather(self.first[rows], size)], size
