"""Spelling variants by permuterm rotations.

A word is marked with a terminator and rotated to each of its places. With
w = A c B, the rotation that begins after c is B$A c, so words that differ from
w in c alone share all of it but its last character, and a word that lacks c
has B$A as a whole rotation. Each rotation is thus sent under the prefix that
skips the edited character, and each whole rotation under itself; sorted, the
rows of one prefix stand together: words with one character more (at most one
for each letter) and at most one word without it. A scan over the sorted rows
counts each row's neighbours and keeps the best of them; no pair is written.

A deletion from a run of equal characters gives one word whichever goes, so
only the first of a run stands for an inserted character; a pair of words is
near by exactly one prefix, and counts add up.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, text_or_empty
from .flat import blocks, runs
from .interned import SHORT, Interned, words

LEAST_LENGTH, LEAST_COUNT, RARE, RATIO = 5, 3, 97, 2
#: Distinct runs that a task holds before it passes their counts on; keys of up to so many characters are written out, longer ones as a hash.
HELD, PLAIN = 1_000_000, 64
MARK = b"$"
#: Modulus and base of the hash of longer keys.
PRIME, BASE = 2**127 - 1, 0x5851F42D4C957F2D14057B7EF767814F
_U = np.uint64

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _zero_step() -> np.ndarray:
    """What a CRC register's low byte becomes when a zero byte passes."""
    return np.array([~zlib.crc32(b"\0", ~i & 0xFFFFFFFF) & 0xFFFFFFFF for i in range(256)], np.uint32)


class RunCounter:
    """Counts of the runs of a task's texts after the rule that deletes a character here and there.

    A CRC is linear: that of id and run together is the register after the id,
    moved on by as many zero bytes as the run has, combined with the run's own.
    """

    def __init__(self) -> None:
        self.step = _zero_step()
        self.clear()

    def clear(self) -> None:
        self.known, self.counts, self.own = Interned(), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.uint32)
        self.bytes: list[bytes] = []
        self.changed: Counter[bytes] = Counter()

    def block(self, buf: np.ndarray, off: np.ndarray, ids: list[str]) -> None:
        buf = _LOWER[buf]
        letter = _LETTER[buf]
        latin = buf == 0xC3  # the lead byte of U+00C0 to U+00FF
        letter |= latin
        letter[1:] |= latin[:-1]
        start, end, _ = runs(letter.view(np.uint8), off)
        if not len(start):
            return
        row, fresh = self.known.rows(buf, start, end)
        raw = buf.tobytes()
        if len(fresh):
            new = [raw[a:b] for a, b in zip(start[fresh].tolist(), end[fresh].tolist(), strict=True)]
            while self.known.count > len(self.counts):
                self.counts, self.own = np.concatenate((self.counts, np.zeros_like(self.counts))), np.concatenate((self.own, self.own))
            self.own[self.known.count - len(new) : self.known.count] = [~zlib.crc32(x, 0xFFFFFFFF) & 0xFFFFFFFF for x in new]
            self.bytes += new
        size = end - start
        text = np.searchsorted(off, start, "right") - 1
        first = np.array([~zlib.crc32(f"{i}:".encode()) & 0xFFFFFFFF for i in ids], np.uint32)
        moved = np.empty((SHORT + 1, len(ids)), np.uint32)
        moved[0] = first
        for k in range(SHORT):
            moved[k + 1] = self.step[moved[k] & 0xFF] ^ moved[k] >> 8
        crc = ~(moved[np.minimum(size, SHORT), text] ^ self.own[row])
        for i in np.flatnonzero(size > SHORT).tolist():
            crc[i] = zlib.crc32(raw[start[i] : end[i]], int(~first[text[i]] & 0xFFFFFFFF))
        hit = crc % RARE == 0
        self.counts[: self.known.count] += np.bincount(row[~hit], minlength=self.known.count)
        for r, h in zip(row[hit].tolist(), crc[hit].tolist(), strict=True):
            run = self.bytes[r].decode()
            at = h % len(run)
            self.changed[(run[:at] + run[at + 1 :]).encode()] += 1

    def batches(self) -> Iterator[pa.RecordBatch]:
        """All counts so far, words of too few characters left out."""
        some = [(w, c) for w, c in zip(self.bytes, self.counts.tolist(), strict=False) if c and len(w) >= LEAST_LENGTH and len(w) - w.count(0xC3) >= LEAST_LENGTH]
        some += [(w, c) for w, c in self.changed.items() if len(w) - w.count(0xC3) >= LEAST_LENGTH]
        for i in range(0, len(some), 10_000):
            part = some[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()).cast(pa.string()), pa.array([c for _, c in part], pa.int64())], names=["word", "n"])
        self.clear()


def word_counts(docs: DataFrame) -> DataFrame:
    """The words of documents (doc_id, text) and how often each occurs: word, n. At least five characters and three occurrences; a null id counts as the empty string, a null text as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = RunCounter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, buf, off in blocks(batch.column(1)):
                c.block(buf, off, ids[i:j])
                if c.known.count + len(c.changed) > HELD:
                    yield from c.batches()
        yield from c.batches()

    found = map_arrow(docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), text_or_empty().alias("text")), run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _fixed(rows: np.ndarray, width: int) -> pa.Array:
    """An array of byte strings of one width from a matrix of bytes."""
    rows = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(rows)])


def _long_keys(word: bytes, size: int) -> list[bytes]:
    """A hash of each of the ``size`` + 0 characters that begin at each place of word$word, where that wraps around no further than the word."""
    text = word + MARK + word
    c, power = [0], [1]
    for b in text:
        c.append((c[-1] * BASE + b + 1) % PRIME)
    for _ in range(size):
        power.append(power[-1] * BASE % PRIME)
    return [b"\0" + ((c[i + size] - c[i] * power[size]) % PRIME).to_bytes(16, "little") for i in range(len(text) - size + 1)]


def _meta(n: np.ndarray, whole: np.ndarray | bool, first: np.ndarray | bool) -> np.ndarray:
    return n << 2 | np.asarray(whole).astype(np.int64) << 1 | np.asarray(first).astype(np.int64)


def rotations(table: DataFrame) -> DataFrame:
    """Rows (key, id, meta) of words (id, word, n): 2 L + 1 for a word of L characters. meta: n, whether the rotation is a whole one, whether the skipped character is the first of its run."""

    def one_length(w: np.ndarray, ids: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        count, size = w.shape
        text = np.concatenate((w, np.full((count, 1), MARK[0], np.uint8), w), axis=1)
        first = np.ones((count, size), bool)
        first[:, 1:] = w[:, 1:] != w[:, :-1]
        for width, begin, times in ((size, 1, size), (size + 1, 0, size + 1)):
            whole = width > size
            if width > PLAIN:
                for r in range(count):
                    keys = _long_keys(w[r].tobytes(), width)[begin : begin + times]
                    meta = np.broadcast_to(_meta(n[r], whole, False if whole else first[r]), times)
                    for i in range(0, times, 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 10_000], pa.binary()), pa.array(np.full(len(keys[i : i + 10_000]), ids[r])), pa.array(meta[i : i + 10_000])], names=["key", "id", "meta"])
                continue
            keys = np.lib.stride_tricks.sliding_window_view(text, width, axis=1)[:, begin : begin + times].reshape(-1, width)
            meta = _meta(np.repeat(n, times), whole, False if whole else first.ravel())
            yield pa.RecordBatch.from_arrays([_fixed(keys, width), pa.array(np.repeat(ids, times)), pa.array(np.broadcast_to(meta, count * times))], names=["key", "id", "meta"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [w.encode("latin-1") for w in batch.column(1).to_pylist()]
            size, ids, n = np.fromiter(map(len, raw), np.int64, len(raw)), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for s in np.unique(size).tolist():
                some = np.flatnonzero(size == s)
                step = max(1, 50_000 // s)
                for i in range(0, len(some), step):
                    part = some[i : i + step]
                    yield from one_length(np.frombuffer(b"".join(raw[k] for k in part.tolist()), np.uint8).reshape(len(part), s), ids[part], n[part])

    return map_arrow(table.select("id", "word", "n"), run, "key binary, id bigint, meta bigint")


def _firsts(group: np.ndarray, n: np.ndarray, ids: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """For each group the row of largest n (ties: smallest id) and the next one, -1 where there is none."""
    order = np.lexsort((ids, -n, group))
    at = np.searchsorted(group[order], np.arange(groups + 1))
    one, two = np.full(groups, -1, np.int64), np.full(groups, -1, np.int64)
    has, more = at[1:] > at[:-1], at[1:] > at[:-1] + 1
    one[has], two[more] = order[at[:-1][has]], order[at[:-1][more] + 1]
    return one, two


def _scan(keys: pa.Array, ids: np.ndarray, meta: np.ndarray) -> pa.RecordBatch | None:
    """Neighbours within whole groups of sorted rows: for each row that has some their number and the best one."""
    rows = len(keys)
    new = np.ones(rows, bool)
    if rows > 1:
        new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    some = np.flatnonzero(size[group] > 1)
    if not len(some):
        return None
    group = np.unique(group[some], return_inverse=True)[1]
    ids, meta = ids[some], meta[some]
    n, whole, first = meta >> 2, (meta & 2) > 0, (meta & 1) > 0
    groups = int(group[-1]) + 1
    edited = np.flatnonzero(~whole)
    added = np.flatnonzero(~whole & first)
    one, two = (np.where(x < 0, -1, edited[x]) for x in _firsts(group[edited], n[edited], ids[edited], groups))
    lead = _firsts(group[added], n[added], ids[added], groups)[0]
    lead = np.where(lead < 0, -1, added[lead] if len(added) else -1)
    base = np.full(groups, -1, np.int64)
    base[group[whole]] = np.flatnonzero(whole)
    own = np.arange(len(ids))
    other = np.where(one[group] == own, two[group], one[group])  # the best replacement
    less = np.where(first, base[group], -1)
    count = np.where(whole, np.bincount(group[added], minlength=groups)[group], np.bincount(group[edited], minlength=groups)[group] - 1 + (less >= 0))

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where((b >= 0) & ((a < 0) | (n[b] > n[a]) | ((n[b] == n[a]) & (ids[b] < ids[a]))), b, a)

    best = np.where(whole, lead[group], better(other, less))
    has = np.flatnonzero(count > 0)
    if not len(has):
        return None
    return pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(count[has]), pa.array(-n[best[has]]), pa.array(ids[best[has]])], names=["id", "n_near", "less", "near"])


def neighbours(table: DataFrame) -> DataFrame:
    """For words (id, word, n), ids in the order of the words, those with a near word: id, n_near, near (the near word of largest n, ties to the smallest), near_n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            key = batch.column(0)
            last = key[len(key) - 1]
            keep = len(batch) - 1
            while keep and key[keep - 1] == last:
                keep -= 1  # the rows of a key are no more than there are letters
            if keep:
                t = pa.Table.from_batches([*held, batch.slice(0, keep)]).combine_chunks()
                out = _scan(t.column(0).combine_chunks(), t.column(1).to_numpy(), t.column(2).to_numpy())
                held = []
                if out is not None:
                    yield out
            elif held and held[-1].column(0)[0] != last:
                t = pa.Table.from_batches(held).combine_chunks()
                out = _scan(t.column(0).combine_chunks(), t.column(1).to_numpy(), t.column(2).to_numpy())
                held = []
                if out is not None:
                    yield out
            held.append(batch.slice(keep))
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            out = _scan(t.column(0).combine_chunks(), t.column(1).to_numpy(), t.column(2).to_numpy())
            if out is not None:
                yield out

    rows = rotations(table).repartition("key").sortWithinPartitions("key")
    best = F.min(F.struct("less", "near")).alias("best")
    return map_arrow(rows, run, "id bigint, n_near bigint, less bigint, near bigint").groupBy("id").agg(F.sum("n_near").alias("n_near"), best).select("id", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """Follow (id, to) to the last: each round doubles the steps taken. An n at least doubles from a word to its form, so chains are short."""
    now = materialize(forms, "forms")
    while True:
        after = now.select(F.col("id").alias("to"), F.col("to").alias("next"))
        step = materialize(now.join(after, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "forms")
        more = step.where("moved").limit(1).count()
        discard(now)
        now = step.select("id", "to")
        now._tickloom_path = step._tickloom_path
        if not more:
            return now


def variants(docs: DataFrame) -> DataFrame:
    """Words of documents (doc_id, text), their near words, forms and roots.

    Words are runs of Latin letters, A-Z in lower case, of at least five
    characters and three occurrences; in about one of 97 runs, by a CRC of id
    and run, a character is deleted first. Returns word, n, n_near (words that
    differ by one inserted, deleted or replaced character), form (the near word
    of largest n, ties to the smallest, if that n is at least twice the word's),
    form_n, root (where forms lead in the end, the word itself without one).

    A null text has no words, a null doc_id counts as the empty string,
    repeated rows are counted each, an empty table gives no rows, other columns
    are not read. Runs of any length are taken whole; keys of over 64
    characters are compared by a 127-bit hash.
    """
    counted = materialize(word_counts(docs), "words")
    table = materialize(counted.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "words")
    discard(counted)
    near = neighbours(table)
    has = F.col("near_n") >= RATIO * F.col("n")
    formed = materialize(
        table.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("near")).alias("to"), F.when(has, F.col("near_n")).alias("form_n")),
        "formed",
    )
    ends = _roots(formed.where("to is not null").select("id", "to")).select("id", F.col("to").alias("end"))
    form, root = (table.select(F.col("id").alias(k), F.col("word").alias(v)) for k, v in (("to", "form"), ("end", "root")))
    named = formed.where("to is not null").join(ends, "id").join(form, "to").join(root, "end")
    out = named.select("word", "n", "n_near", "form", "form_n", "root")
    alone = formed.where("to is null").select("word", "n", "n_near", F.lit(None).cast("string").alias("form"), "form_n", F.col("word").alias("root"))
    return out.unionByName(alone)
