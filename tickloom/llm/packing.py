"""Packing of documents into token windows by best-fit decreasing.

Whole texts are encoded where they are read, and a document that is longer than
a window is cut into full windows and a rest. What packs is a row of a few
integers for each piece: these are written, dealt over groups of about
``GROUP`` pieces, whatever the partitions of the input, and each group is packed
by best-fit decreasing. A lost task is simply run again from the written pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, text_or_empty
from .flat import Known, Store, blocks, per_text, prefix, runs, segment_sum, span_hash

#: Bits of a sequence id that count the windows of one group; pieces of a group.
LOCAL_BITS, GROUP = 40, 100_000
#: Word parts whose ids a worker keeps.
MAX_PARTS = 2_000_000
OUT = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _classes() -> np.ndarray:
    """Class of each byte of lower-case plain text: 1 letter, 2 digit, 3 mark, 0 white space."""
    cls = np.full(256, 3, np.uint8)
    cls[[9, 10, 11, 12, 13, 32]] = 0
    cls[ord("0") : ord("9") + 1] = 2
    cls[ord("a") : ord("z") + 1] = 1
    cls[ord("A") : ord("Z") + 1] = 1
    cls[0x80:] = 1  # second bytes and letters of two bytes; _two_bytes mends the others
    return cls


CLASSES = _classes()
#: Second bytes after 0xC2 that stand for letters and for numbers; the others are marks. After 0xC3, 0x97 and 0xB7 are marks.
C2_LETTERS, C2_NUMBERS = (0xAA, 0xB5, 0xBA), (0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE)
SUFFIX_1, SUFFIX_2 = b"stmd", (b"re", b"ve", b"ll")


class WordIds:
    """Ids of texts by a ``tokenizers`` file whose tokens never cross word parts.

    The parts (a run of letters, one digit, a run of marks, an English suffix
    after an apostrophe) are found for a block of texts at once; the library's
    own model encodes each distinct part once, and its ids are kept. A text
    with anything but Latin letters of at most two bytes, where normal forms,
    special strings or case rules could matter, goes to the library as a whole.
    """

    def __init__(self, path: str, end_id: int = 1):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.end = end_id
        keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others follow from 256 on
        rest = iter(range(256, 512))
        self.bytes = {b: b if b in set(keep) else next(rest) for b in range(256)}
        self.clear()

    def clear(self) -> None:
        self.known, self.store = Known(), Store(np.uint32)

    def learn(self, parts: list[bytes]) -> None:
        tokenize, table = self.model.tokenize, self.bytes
        got = [[t.id for t in tokenize(p.decode("latin-1").translate(table))] for p in parts]
        size = np.fromiter(map(len, got), np.int64, len(got))
        self.store.add(np.fromiter((i for x in got for i in x), np.uint32, int(size.sum())), size)

    def block(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For lower-case texts: their ids one after the other, the bounds of each text's, and which texts the library must encode as a whole."""
        cls = CLASSES[buf]
        nxt = np.append(buf[1:], 0)
        odd = (buf >= 0xC6) | ((buf == 0xC2) & (nxt <= 0xA0)) | ((buf >= 0x1C) & (buf <= 0x1F)) | ((buf == 0x3C) & (nxt == 0x7C))
        for lead, seconds, kind in ((0xC2, None, 3), (0xC2, C2_LETTERS, 1), (0xC2, C2_NUMBERS, 2), (0xC3, (0x97, 0xB7), 3)):
            at = np.flatnonzero(buf[:-1] == lead)
            if seconds is not None:
                at = at[np.isin(buf[at + 1], seconds)]
            cls[at] = cls[at + 1] = kind
        start, end, kind = runs(cls, off, alone=2)
        if len(start):  # a number of two bytes is one part
            tail = (kind == 2) & (buf[start] >= 0x80) & (buf[start] < 0xC0)
            lead = np.flatnonzero(tail) - 1
            end[lead] = end[lead + 1]
            start, end, kind = start[~tail], end[~tail], kind[~tail]
        start, end = self.suffixes(buf, start, end, kind)
        h = span_hash(prefix(buf), start, end)
        row = self.known.find(h)
        new = self.known.distinct_new(h, row)
        if len(new):
            if self.known.count + len(new) > MAX_PARTS:
                self.clear()
                new = self.known.distinct_new(h, np.full(len(h), -1))
            raw = buf.tobytes()
            self.learn([raw[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            self.known.add(h[new])
            row = self.known.find(h)
        ids, size = self.store.take(row)
        bounds = np.concatenate(([0], np.cumsum(size)))[per_text(start, off)]
        return ids, bounds, segment_sum(odd, off) > 0

    @staticmethod
    def suffixes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A lone apostrophe right before s, t, m, d, re, ve or ll takes these letters."""
        at = np.flatnonzero((kind[:-1] == 3) & (buf[start[:-1]] == 0x27) & (end[:-1] - start[:-1] == 1) & (kind[1:] == 1) & (start[1:] == end[:-1])) if len(start) else np.zeros(0, np.int64)
        if not len(at):
            return start, end
        a, size = start[at + 1], end[at + 1] - start[at + 1]
        one = np.isin(buf[a], np.frombuffer(SUFFIX_1, np.uint8))
        second = buf[np.minimum(a + 1, len(buf) - 1)]
        two = np.zeros(len(at), bool)
        for x in SUFFIX_2:
            two |= (size >= 2) & (buf[a] == x[0]) & (second == x[1])
        take = np.where(one, 1, np.where(two, 2, 0))
        start, end = start.copy(), end.copy()
        end[at] += take
        start[at + 1] += take
        keep = end > start
        return start[keep], end[keep]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text with the end id after them."""
        lower = pc.utf8_lower(texts)
        dotted = pc.match_substring(texts, "İ").to_numpy(zero_copy_only=False)  # the one letter whose lower case is two
        for i, j, buf, off in blocks(lower):
            ids, bounds, odd = self.block(buf, off)
            for k in range(i, j):
                own = np.array(self.full.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32) if odd[k - i] or dotted[k] else ids[bounds[k - i] : bounds[k - i + 1]]
                yield np.append(own, np.uint32(self.end)).astype("<u4", copy=False)


class TightestOpen:
    """A segment tree over remaining capacities 0..size: which is the least one, at least so large, that an open window has?"""

    def __init__(self, size: int):
        self.leaf = 1 << size.bit_length()
        self.any = bytearray(2 * self.leaf)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        if len(self.open[room]) == 1:
            i = self.leaf + room
            while i and not self.any[i]:
                self.any[i] = 1
                i >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The tightest open window with room for so many tokens: (room, window)."""
        i, tree = self.leaf + length, self.any
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):  # up, until a right neighbour has an open window
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaf:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.leaf
        window = self.open[room].pop()
        if not self.open[room]:
            tree[i] = 0
            i >>= 1
            while i and not (tree[2 * i] or tree[2 * i + 1]):
                tree[i] = 0
                i >>= 1
        return room, window


def best_fit(lengths: np.ndarray, order: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; pieces are placed in ``order``, longest first."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = TightestOpen(size), 0
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        if length == size or (got := tree.take(length)) is None:
            got, n = (size, n), n + 1
        room, w = got
        window[i], offset[i] = w, size - room
        if room > length:
            tree.put(room - length, w)
    return window, offset


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """A worker's one encoder for a file; its words outlive a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most ``size`` tokens.

    Returns a row for each piece: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, and with ``with_ids`` the piece's ids.
    A null text is empty; an empty document is its end id alone. A null
    doc_id is kept as null, repeated rows are packed each by itself, and an
    empty table gives no rows. Other columns of ``docs`` are not read.
    """
    light = ["piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        piece = TaskContext.get().partitionId() << LOCAL_BITS
        for batch in batches:
            rows: list[list] = [[] for _ in light]
            parts: list[np.ndarray] = []
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                n = len(ids)
                for at in range(0, n, size):
                    part = ids[at : at + size]
                    for to, x in zip(rows, (piece, doc, at, len(part), zlib.crc32(part), n), strict=True):
                        to.append(x)
                    piece += 1
                    if with_ids:
                        parts.append(part.astype(np.int32))
            cols = [pa.array(x, pa.int64()) for x in rows]
            if with_ids:
                cols.append(pa.array(parts, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[*light, "ids"][: len(cols)])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        t = pa.Table.from_batches(held)
        piece, key, start, length, crc = (t[x].fill_null(-1).to_numpy() for x in ("piece", "doc_id", "start", "length", "ids_crc32"))
        window, offset = best_fit(length, np.lexsort((piece, start, key, crc, -length)), size)
        first = TaskContext.get().partitionId() << LOCAL_BITS
        yield from t.append_column("sequence_id", pa.array(window + first)).append_column("offset", pa.array(offset)).to_batches(1 << 14)

    kinds = ", ".join(f"{x} bigint" for x in light)
    pieces = map_arrow(docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text")), cut, kinds + (", ids array<int>" if with_ids else ""))
    pieces = materialize(pieces, "pack-pieces")
    groups = max(1, -(-pieces.count() // GROUP))
    packed = map_arrow(pieces.select(*light).repartition(groups, "piece"), best, kinds + ", sequence_id bigint, offset bigint")
    if with_ids:
        packed = packed.join(pieces.select("piece", "ids"), "piece")
    return packed.select(*OUT, *(["ids"] if with_ids else []))
