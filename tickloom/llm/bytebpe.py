"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the rest by merging.

A text is cut into pre-tokens on its UTF-8 bytes, by classes of characters
(letters, numbers, white space, others) and what the pattern says about spaces
and contractions. A pre-token that the vocabulary has as a whole is one id: a
minimal perfect hash gives the only slot that could hold it, and its bytes are
compared. Any other is merged by rank: a heap holds the pairs of neighbours, a
linked list the parts, so a pre-token of n bytes takes n log n steps. A worker
keeps the ids of pre-tokens that it has merged.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_or_empty
from .flat import Store, blocks, gather, mix, per_text
from .interned import SHORT, Interned, words

#: Merged pre-tokens that a worker keeps, and bytes of the long ones among them.
KEEP, KEEP_BYTES = 2_000_000, 32 << 20
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_U = np.uint64


class PerfectHash:
    """A minimal perfect hash of n distinct 64-bit keys: buckets, largest first, take the first displacement that sends all their keys to free slots; single keys take what is left."""

    STEP = _U(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        self.n, self.buckets = len(keys), max(1, len(keys) // 4)
        if len(np.unique(keys)) != self.n:
            raise ValueError("two keys share a hash")
        own = self._bucket(keys)
        order = np.argsort(own, kind="stable")
        first, size = np.searchsorted(own[order], np.arange(self.buckets)), np.bincount(own, minlength=self.buckets)
        self.shift, taken = np.zeros(self.buckets, np.int64), np.zeros(self.n, bool)
        for b in np.argsort(-size, kind="stable").tolist():
            if size[b] < 2:
                break
            mine, d, width = keys[order[first[b] : first[b] + size[b]]], 0, 64
            while True:
                slots = self._slot(mine[None, :], np.arange(d, d + width)[:, None])
                fits = ~taken[slots].any(axis=1) & (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
                if fits.any():
                    break
                d, width = d + width, min(2 * width, 4096)
            at = int(np.argmax(fits))
            self.shift[b] = d + at
            taken[slots[at]] = True
        single = np.flatnonzero(size == 1)
        self.shift[single] = -1 - np.flatnonzero(~taken)[: len(single)]

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return (((h >> _U(32)) * _U(self.buckets)) >> _U(32)).astype(np.int64)

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (((mix(h + (d + 1).astype(np.uint64) * self.STEP) >> _U(32)) * _U(self.n)) >> _U(32)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each key; one of any slot for what is no key."""
        d = self.shift[self._bucket(h)]
        return np.where(d < 0, -1 - d, self._slot(h, np.maximum(d, 0)))


def classes() -> np.ndarray:
    """The class of each code point, as the tokenizer's own pattern engine sees it."""
    import tiktoken

    points = np.concatenate((np.arange(0xD800, dtype=np.uint32), np.arange(0xE000, 0x110000, dtype=np.uint32)))
    text = points.tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        engine = tiktoken.Encoding("members", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        out[np.frombuffer(bytes(engine.encode_ordinary(text)).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


class Codec:
    """Encoder and decoder for a file of ranks (base64 bytes, rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.widest = max(map(len, self.ranks))
        self.kind = classes()
        tokens = sorted(self.ranks, key=self.ranks.get)
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        end = np.cumsum(size)
        w, h = words(np.frombuffer(b"".join(tokens), np.uint8), end - size, end)
        self.hash = PerfectHash(h)
        slot = self.hash.find(h)
        self.words, self.size, self.ids = np.empty_like(w), np.empty_like(size), np.empty(len(tokens), np.int32)
        self.words[slot], self.size[slot], self.ids[slot] = w, size, np.array([self.ranks[t] for t in tokens], np.int32)
        top = max(self.ranks.values()) + 1
        by_id: list[bytes] = [b""] * top
        for t, r in self.ranks.items():
            by_id[r] = t
        self.bytes = pa.array(by_id, pa.large_binary())
        self.digits = pa.array([b"%d " % i for i in range(top)], pa.large_binary())
        self.clear()

    def clear(self) -> None:
        self.met, self.store, self.long = Interned(), Store(np.int32), 0

    def pre_tokens(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where the pre-tokens of a block of texts begin; each ends where the next one begins."""
        n = len(buf)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.kind[:256][buf]
        lead = np.flatnonzero(buf >= 0xC0)
        if len(lead):
            b0 = buf[lead].astype(np.int64)
            more = 1 + (b0 >= 0xE0) + (b0 >= 0xF0)
            point = b0 & np.array([0, 0x1F, 0x0F, 0x07])[more]
            for k in (1, 2, 3):
                has = more >= k
                point[has] = point[has] << 6 | (buf[lead[has] + k] & 0x3F)
            c = self.kind[point]
            kind[lead] = c
            for k in (1, 2, 3):
                has = more >= k
                kind[lead[has] + k] = c[has]
        bound = np.zeros(n + 1, bool)
        bound[off] = True
        bound[n] = True
        cut = bound[:n].copy()
        cut[1:] |= kind[1:] != kind[:-1]
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        # the last character of white space before something else stands by itself, and a blank there joins what follows
        inner = (kind[start] == SPACE) & ~bound[end]
        b = end[inner]
        whole = np.where((buf & 0xC0) != 0x80, np.arange(n), 0)
        last = np.maximum.accumulate(whole)[b - 1]
        cut[last] = True
        cut[b[buf[last] == 0x20]] = False
        # contractions: an apostrophe alone, joined to no blank, and the letters after it
        a = start[(end - start == 1) & (buf[start] == 0x27)]
        a = a[cut[a] & ~bound[a + 1]]
        if len(a):
            pad = np.concatenate((buf, np.zeros(2, np.uint8)))
            one, two = pad[a + 1], np.where(bound[np.minimum(a + 2, n)], 0, pad[a + 2])
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            wide = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
            for at, k in ((a[short], 2), (a[wide], 3)):
                cut[at + 1] = False
                cut[(at + k)[at + k < n]] = True
                # what follows may be a bound or another class already; a letter begins a pre-token of its own
        return np.flatnonzero(cut)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost of equals, until none is left. The heap holds rank * n + place of the pair's first byte."""
        n, get, widest, pop, push = len(piece), self.ranks.get, self.widest, heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [get(piece[i : i + 2], -1) for i in range(n - 1)]
        rank.append(-1)
        heap = [r * n + i for i, r in enumerate(rank) if r >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = divmod(pop(heap), n)
            if rank[i] != r:
                continue  # one of the pair has been merged since
            j = after[i]
            k = after[i] = after[j]
            rank[j] = rank[i] = -1
            if k < n:
                before[k] = i
                e = after[k]
                if e - i <= widest and (new := get(piece[i:e], -1)) >= 0:
                    rank[i] = new
                    push(heap, new * n + i)
            p = before[i]
            if p >= 0:
                rank[p] = new = get(piece[p:k], -1) if k - p <= widest else -1
                if new >= 0:
                    push(heap, new * n + p)
        out, i = [], 0
        while i < n:
            k = after[i]
            out.append(self.ranks[piece[i:k]])
            i = k
        return out

    def block(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block of texts one after the other, and the bounds of each text's."""
        start = self.pre_tokens(buf, off)
        end = np.append(start[1:], len(buf))
        w, h = words(buf, start, end)
        slot = self.hash.find(h)
        hit = (self.size[slot] == end - start) & (self.words[slot] == w).all(axis=1)
        far = np.flatnonzero(hit & (end - start > SHORT))
        if len(far):
            raw = buf.tobytes()
            hit[far] = [self.ranks.get(raw[a:b]) == i for a, b, i in zip(start[far].tolist(), end[far].tolist(), self.ids[slot[far]].tolist(), strict=True)]
        size = np.ones(len(start), np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            if self.met.count > KEEP or self.long > KEEP_BYTES:
                self.clear()
            s, e = start[miss], end[miss]
            row, fresh = self.met.rows(buf, s, e, (w[miss], h[miss]))
            if len(fresh):
                raw = buf.tobytes()
                got = [self.merge(raw[a:b]) for a, b in zip(s[fresh].tolist(), e[fresh].tolist(), strict=True)]
                self.store.add(np.fromiter((i for x in got for i in x), np.int32), np.fromiter(map(len, got), np.int64, len(got)))
                wide = (e - s)[fresh]
                self.long += int(wide[wide > SHORT].sum())
            merged, size[miss] = self.store.take(row)
        at = np.concatenate(([0], np.cumsum(size)))
        ids = np.empty(at[-1], np.int32)
        ids[at[:-1][hit]] = self.ids[slot[hit]]
        if len(miss):
            ids[gather(at[miss], size[miss])] = merged
        return ids, at[per_text(start, off)]

    def texts(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each block of a column without nulls: its first row, the ids, and the bounds of each row's."""
        for i, _, buf, off in blocks(column):
            yield i, *self.block(buf, off)

    def joined(self, table: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """What a table has for each id, joined for each text."""
        got = table.take(pa.array(ids))
        off = np.frombuffer(got.buffers()[1], np.int64)[got.offset : got.offset + len(got) + 1] if len(got) else np.zeros(1, np.int64)
        raw = memoryview(got.buffers()[2] or b"") if len(got) else memoryview(b"")
        at = off[bounds].tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """A worker's one codec for a file; what it has merged outlives a task."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text"))


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """The ids of each whole text of documents (doc_id, text): doc_id, ids array<int>.

    A null text is empty and has no ids; a null doc_id stays null; repeated
    rows are encoded each; an empty table gives no rows; other columns are not
    read. Texts and unbroken words of any length are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, ids, bounds in codec(ranks).texts(batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(lists)), lists], names=["doc_id", "ids"])

    return map_arrow(_rows(docs), run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """The bytes of each list of ids (doc_id, ids): doc_id, bytes binary. A null list is empty; an id that the file lacks raises an error, a null id too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks)
        for batch in batches:
            for i in range(len(batch)):  # a list at a time, so that no batch of bytes is larger than one text
                ids = batch.column(1).slice(i, 1).flatten()
                if ids.null_count:
                    raise ValueError("a null id")
                part = c.joined(c.bytes, ids.to_numpy(), np.array([0, len(ids)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([bytes(part[0])], pa.binary())], names=["doc_id", "bytes"])

    return map_arrow(encoded.select(F.col("doc_id").cast("bigint"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids")), run, "doc_id bigint, bytes binary")


def digests(docs: DataFrame, ranks: str) -> DataFrame:
    """Each text encoded and decoded again, as digests: doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 (the bytes that the ids stand for). Nulls, empty texts, repeats as in ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks)
        for batch in batches:
            for i, ids, bounds in c.texts(batch.column(1)):
                listed = [hashlib.sha256(x[: max(0, len(x) - 1)]).hexdigest() for x in c.joined(c.digits, ids, bounds)]
                plain = [hashlib.sha256(x).hexdigest() for x in c.joined(c.bytes, ids, bounds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(listed)), pa.array(np.diff(bounds)), pa.array(listed), pa.array(plain)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(_rows(docs), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
