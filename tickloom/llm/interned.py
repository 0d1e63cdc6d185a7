"""Byte strings of a block as numbers, exactly.

A string of up to ``SHORT`` bytes is three words of eight bytes, so that whole
blocks are hashed, looked up and compared as arrays; longer ones, and any whose
hash is another's, go through a dictionary of their bytes.
"""

from __future__ import annotations

import zlib

import numpy as np

from .flat import Known, mix

SHORT = 24
_U = np.uint64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def words(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 24 bytes of each span as words [n, 3], zeros after its end, and a hash of the span."""
    padded = np.zeros(len(buf) + 2 * SHORT, np.uint8)
    padded[: len(buf)] = buf
    at = np.ndarray((len(buf) + SHORT + 8,), "<u8", padded, 0, (1,))  # the word that begins at each byte
    size = end - start
    out = np.empty((len(start), 3), np.uint64)
    for k in range(3):
        out[:, k] = at[np.minimum(start + 8 * k, len(at) - 1)] & _MASK[np.clip(size - 8 * k, 0, 8)]
    h = mix(out[:, 0] ^ mix(out[:, 1] ^ mix(out[:, 2] + size.astype(np.uint64) * _U(0x2545F4914F6CDD1D))))
    far = np.flatnonzero(size > SHORT)
    if len(far):
        raw = buf.tobytes()
        h[far] = mix(h[far] ^ np.array([zlib.crc32(raw[a:b]) for a, b in zip(start[far].tolist(), end[far].tolist(), strict=True)], np.uint64))
    return out, h


class Interned:
    """Numbers distinct byte strings from 0 on, in the order in which they are met."""

    def __init__(self) -> None:
        self.count = 0
        self.known, self.row_of, self.words = Known(), np.zeros(1 << 12, np.int64), np.zeros((1 << 12, 3), np.uint64)
        self.rest: dict[bytes, int] = {}

    def rows(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, found: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The number of each span, and where the new ones first stand, in the order of their numbers. ``found``: what ``words`` gives."""
        w, h = found if found is not None else words(buf, start, end)
        out = np.full(len(start), -1, np.int64)
        near = np.flatnonzero(end - start <= SHORT)
        hn, wn = h[near], w[near]
        at = self.known.find(hn)
        new = self.known.distinct_new(hn, at)
        before = self.known.count
        if len(new):
            self.known.add(hn[new])
            while self.known.count > len(self.row_of):
                self.row_of, self.words = np.concatenate((self.row_of, self.row_of)), np.concatenate((self.words, self.words))
            self.row_of[before : self.known.count] = self.count + np.arange(len(new))
            self.words[before : self.known.count] = wn[new]
            self.count += len(new)
            at = self.known.find(hn)
        same = (self.words[at] == wn).all(axis=1) if len(at) else np.zeros(0, bool)
        out[near[same]] = self.row_of[at[same]]
        fresh = near[new].tolist()
        odd = np.flatnonzero(out < 0)
        if len(odd):
            raw = buf.tobytes()
            for i in odd.tolist():
                key = raw[start[i] : end[i]]
                row = self.rest.get(key)
                if row is None:
                    row = self.rest[key] = self.count
                    self.count += 1
                    fresh.append(i)
                out[i] = row
        return out, np.array(fresh, np.int64)
