"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else. Every such string has one anchor, the least hash (leftmost of equals) of
its ``GRAM``-byte substrings, so equal strings have their anchors at the same
place, and only about one position in eighty is an anchor:

1. Anchors that share neither their gram nor, then, their whole context (all
   strings that can have this anchor) are settled by counts alone: a gram that
   stands once has no repeat, a context that stands again is repeated as a whole.
   Whole contexts count as equal only if their prefix hash and a BLAKE2b digest
   of their bytes agree.
2. For the rest, contexts of one gram are put in suffix order by a mergesort
   that compares two suffixes through prefix hashes and binary search for their
   common extension; common extensions to both sides of neighbours in that order
   give the repeated strings. Bytes are compared before a match counts.
3. Grams with very many different contexts are split like a suffix tree: all
   are compared with the commonest of them; what a context does not share with
   it holds the first byte on either side where they part, so contexts that may
   still repeat each other agree up to there and meet in a smaller bucket. Most
   are alone in theirs and done; no large group of contexts meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, map_arrow, materialize, text_or_empty
from .flat import INVERSE, blocks, gather, mix, powers, prefix, span_hash

LENGTH, GRAM = 200, 40
#: A row of the input is known by two 64-bit hashes of all its columns.
KEY = ["key", "twin"]
#: Different contexts of a bucket that one task sorts; larger ones are split. Contexts that are sorted at once.
CROWD, CHUNK = 64, 8_000
_U = np.uint64


def anchors(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings of ``length`` bytes in the texts of a block: text, position in the block, and the prefix hash of the block."""
    c = prefix(buf)
    n = len(buf) - gram + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, c
    start = np.arange(n)
    key = (span_hash(c, start, start + gram) & _U(0xFFFFFFFF00000000)) | start.astype(np.uint64)
    wide = length - gram + 1
    if n < wide:
        return none, none, c
    # minimum of every window: of the block's end and the next block's beginning
    rows = -(-n // wide)
    pad = np.full(rows * wide, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = key
    grid = pad.reshape(rows, wide)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    low = np.minimum(back[: n - wide + 1], ahead[wide - 1 : n])
    doc = np.repeat(np.arange(len(off) - 1), np.maximum(np.diff(off) - length + 1, 0))
    first = gather(off[:-1], np.maximum(np.diff(off) - length + 1, 0))
    at = (low[first] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], at[new], c


def _context(doc: np.ndarray, at: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of context on the left and on the right of each anchor's gram."""
    reach = length - gram
    return np.minimum(at - off[doc], reach), np.minimum(off[doc + 1] - at - gram, reach)


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """key, twin, pos, left, right, g (hash of the gram), u and v (prefix hash and digest of the context) of every anchor."""
    names = [*KEY, "pos", "left", "right", "g", "u", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, twins = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, _, buf, off in blocks(batch.column(2)):
                doc, at, c = anchors(buf, off, length, gram)
                left, right = _context(doc, at, off, length, gram)
                g = span_hash(c, at, at + gram)
                u = mix(span_hash(c, at - left, at + gram + right) + left.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
                raw, digest = buf.tobytes(), hashlib.blake2b
                v = np.frombuffer(b"".join([digest(raw[a:b], digest_size=8).digest() for a, b in zip((at - left).tolist(), (at + gram + right).tolist(), strict=True)]), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[i + doc], twins[i + doc], at - off[doc], left.astype(np.int32), right.astype(np.int32), g.view(np.int64), u.view(np.int64), v)], names=names)

    return map_arrow(docs.select(*KEY, "text"), run, "key bigint, twin bigint, pos bigint, left int, right int, g bigint, u bigint, v bigint")


class Sorter:
    """Byte strings of one chunk with prefix hashes; suffixes compare through common extensions."""

    def __init__(self, buf: np.ndarray):
        self.buf, self.c, self.inverse = buf, prefix(buf), powers(len(buf) + 1, INVERSE)

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether buf[a:a+n] and buf[b:b+n] have one hash."""
        c, inv = self.c, self.inverse
        return (c[a + n] - c[a]) * inv[a] == (c[b + n] - c[b]) * inv[b]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension from a and b on, at most ``most``, by binary search."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(a, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def common_left(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The same to the left: of what ends before a and b."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(a - mid, b - mid, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, group: np.ndarray, s: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j (``ties``: or equals it)."""
        out = group[i] < group[j]
        at = np.flatnonzero(group[i] == group[j])
        if len(at):
            a, b = i[at], j[at]
            most = np.minimum(n[a], n[b])
            k = self.common(s[a], s[b], most)
            end = k == most
            last = len(self.buf) - 1
            less = np.where(end, n[a] < n[b], self.buf[np.minimum(s[a] + k, last)] < self.buf[np.minimum(s[b] + k, last)])
            out[at] = less | (ties[at] & end & (n[a] == n[b]))
        return out

    def order(self, group: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Mergesort of the suffixes (start s, length n) within their groups.

        At each level all pairs of neighbouring runs merge at once: a binary
        search finds how many of the other run go before each suffix.
        """
        total = len(s)
        perm = np.arange(total)
        width = 1
        while width < total:
            at = np.arange(total)
            run = at // width
            right = (run & 1).astype(bool)
            other = np.where(right, run - 1, run + 1) * width
            low, high = np.minimum(other, total), np.minimum(other + width, total)
            base = low.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                less = self.before(group, s, n, perm[mid], perm[open_], right[open_])  # equals: the left run first
                low[open_], high[open_] = np.where(less, mid + 1, low[open_]), np.where(less, high[open_], mid)
            to = np.minimum(run, run ^ 1) * width + (at - run * width) + (low - base)
            new = np.empty_like(perm)
            new[to] = perm
            perm = new
            width *= 2
        return perm


def repeats(buf: np.ndarray, off: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts of grams (rows of one group are together): how far repeated strings of ``length`` reach left and right of each gram (-1: none)."""
    srt = Sorter(buf)
    mid = off[:-1] + left
    perm = srt.order(group, mid + gram, right)
    g, m, lf, rt = group[perm], mid[perm], left[perm], right[perm]
    n = len(perm)
    best_l, best_r = np.full(n, -1), np.full(n, -1)
    i = np.flatnonzero(g[:-1] == g[1:]) if n > 1 else np.zeros(0, np.int64)
    step = np.zeros(max(n - 1, 0), np.int64)
    step[i] = srt.common(m[i] + gram, m[i + 1] + gram, np.minimum(rt[i], rt[i + 1]))  # of neighbours in suffix order
    reach = step[i]
    d = 1
    while len(i):
        j = i + d
        l = srt.common_left(m[i], m[j], np.minimum(lf[i], lf[j]))
        ok = l + gram + reach >= length
        a, b, x, y = i[ok], j[ok], l[ok], reach[ok]
        real = _same_bytes(buf, m[a] - x, m[b] - x, x + gram + y)
        a, b, x, y = a[real], b[real], x[real], y[real]
        for k in (a, b):
            np.maximum.at(best_l, k, x)
            np.maximum.at(best_r, k, y)
        d += 1
        keep = i + d < n
        i, reach = i[keep], reach[keep]
        keep = g[i] == g[i + d]
        i, reach = i[keep], reach[keep]
        reach = np.minimum(reach, step[i + d - 1])
    out_l, out_r = np.empty(n, np.int64), np.empty(n, np.int64)
    out_l[perm], out_r[perm] = best_l, best_r
    return out_l, out_r


def _same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Compare the bytes themselves: no match rests on hashes alone."""
    if not len(a):
        return np.zeros(0, bool)
    bad = buf[gather(a, n)] != buf[gather(b, n)]
    at = np.concatenate(([0], np.cumsum(bad)))
    end = np.cumsum(n)
    return at[end] == at[end - n]


def _by_bytes(buf: np.ndarray, a: int, b: int, gram: int, left: int, right: int) -> tuple[int, int]:
    """Common extensions of two grams found byte by byte; without a common gram what they share is too short to count."""
    if (buf[a : a + gram] != buf[b : b + gram]).any():
        return 0, 0
    x = buf[a - left : a][::-1] != buf[b - left : b][::-1]
    y = buf[a + gram : a + gram + right] != buf[b + gram : b + gram + right]
    return int(np.argmax(x)) if x.any() else left, int(np.argmax(y)) if y.any() else right


CONTEXT = "g bigint, n bigint, key bigint, twin bigint, pos bigint, left int, right int, crowd boolean, ctx binary"


def _contexts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes around wanted anchors: a row for each, from texts with the list of them."""
    names = ["g", "n", *KEY, "pos", "left", "right", "crowd", "ctx"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for key, twin, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                raw = memoryview(text.as_buffer())
                for w in wanted:
                    p = w["pos"]
                    for to, x in zip(rows, (w["g"], w["n"], key, twin, p, w["left"], w["right"], w["crowd"], bytes(raw[p - w["left"] : p + gram + w["right"]])), strict=True):
                        to.append(x)
            types = (*[pa.int64()] * 5, pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names=names)

    return map_arrow(docs.select(*KEY, "text", "wanted"), run, CONTEXT)


def _sorted_spans(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Repeated spans (key, twin, lo, hi) of contexts in buckets (b) with few of them."""

    def work(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        ctx = t["ctx"].combine_chunks()
        if isinstance(ctx, pa.ChunkedArray):
            ctx = pa.concat_arrays(ctx.chunks)
        _, _, buf, off = next(blocks(ctx, 1 << 60))
        left, right = t["left"].to_numpy().astype(np.int64), t["right"].to_numpy().astype(np.int64)
        l, r = repeats(buf, off, left, right, t["b"].to_numpy(), length, gram)
        keep = (l >= 0) & (t["n"].to_numpy() == 1)
        pos = t["pos"].to_numpy()
        yield pa.RecordBatch.from_arrays([*(pa.array(t[k].to_numpy()[keep]) for k in KEY), pa.array((pos - l)[keep]), pa.array((pos + gram + r)[keep])], names=[*KEY, "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            g = batch.column(0).to_numpy()
            if not len(g):
                continue
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            at = 0
            for a, b in zip(cuts, cuts[1:], strict=False):
                if size + b - at > CHUNK and (a > at or held) and g[a] != (last if a == 0 else g[a - 1]):
                    if a > at:
                        held.append(batch.slice(at, a - at))
                    yield from work(held)
                    held, size, at = [], 0, a
            held.append(batch.slice(at))
            size += len(g) - at
            last = g[-1]
        if held:
            yield from work(held)

    few = contexts.select("b", "n", *KEY, "pos", "left", "right", "ctx").repartition("b").sortWithinPartitions("b")
    return map_arrow(few, run, "key bigint, twin bigint, lo bigint, hi bigint")


def _parted(pairs: DataFrame, length: int, gram: int) -> DataFrame:
    """Compare contexts with their bucket's pivot: repeated spans (b null; x, y: the span), and the buckets (b) where what is left may still repeat (x, y: bytes of its core left and right of the gram)."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            col = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
            _, _, own, off1 = next(blocks(col["ctx"], 1 << 60))
            _, _, other, off2 = next(blocks(col["p_ctx"], 1 << 60))
            srt = Sorter(np.concatenate((own, other)))
            num = {k: col[k].to_numpy().astype(np.int64) for k in ("n", *KEY, "pos", "left", "right", "cl", "cr", "p_n", "p_key", "p_twin", "p_pos", "p_left", "p_right")}
            a, b = off1[:-1] + num["left"], len(own) + off2[:-1] + num["p_left"]
            l = srt.common_left(a, b, np.minimum(num["left"], num["p_left"]))
            r = srt.common(a + gram, b + gram, np.minimum(num["right"], num["p_right"]))
            for i in np.flatnonzero(~_same_bytes(srt.buf, a - l, b - l, l + gram + r)):  # different strings of one hash: by bytes
                l[i], r[i] = _by_bytes(srt.buf, int(a[i]), int(b[i]), gram, int(l[i]), int(r[i]))
            new = (num["key"] != num["p_key"]) | (num["twin"] != num["p_twin"]) | (num["pos"] != num["p_pos"])
            out: list[tuple] = []
            hit = new & (l + gram + r >= length)
            for one, which in (("", hit & (num["n"] == 1)), ("p_", hit & (num["p_n"] == 1))):
                k, t, p = (num[one + x][which] for x in (*KEY, "pos"))
                out.append((k, t, p, np.zeros(len(k), np.int64), np.ones(len(k), bool), p - l[which], p + gram + r[which]))
            for cl, cr, more in ((np.maximum(num["cl"], l + 1), num["cr"], l < num["left"]), (num["cl"], np.maximum(num["cr"], r + 1), r < num["right"])):
                i = np.flatnonzero(new & more & (cl + cr <= reach))
                bucket = mix(span_hash(srt.c, a[i] - cl[i], a[i] + gram + cr[i]) + cl[i].astype(np.uint64) * _U(0xD1342543DE82EF95))
                out.append((num["key"][i], num["twin"][i], num["pos"][i], bucket.view(np.int64), np.zeros(len(i), bool), cl[i], cr[i]))
            k, t, p, bucket, span, x, y = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(t), pa.array(p), pa.array(bucket, mask=span), pa.array(x), pa.array(y)], names=[*KEY, "pos", "b", "x", "y"])

    return map_arrow(pairs, run, "key bigint, twin bigint, pos bigint, b bigint, x bigint, y bigint")


def _spans(contexts: DataFrame, length: int, gram: int) -> list[DataFrame]:
    """Repeated spans (key, twin, lo, hi) of contexts, as frames to be put together.

    At each level a bucket's contexts agree in at least one byte more, so there
    are at most ``length - gram`` levels; those not needed any more are deleted.
    """
    found: list[DataFrame] = []
    fields = (*KEY, "pos", "left", "right", "n", "ctx")
    now = contexts.select(F.col("g").alias("b"), F.lit(0).cast("bigint").alias("cl"), F.lit(0).cast("bigint").alias("cr"), "crowd", *fields)
    own = None
    while True:
        many = now.where("crowd")
        if not many.limit(1).count():
            found.append(_sorted_spans(now.where("not crowd"), length, gram))
            return found
        if own is None:
            found.append(_sorted_spans(now.where("not crowd"), length, gram))
        else:
            found.append(materialize(_sorted_spans(now.where("not crowd"), length, gram), "sfx-spans"))
        pivot = materialize(many.groupBy("b").agg(F.max_by(F.struct(*[F.col(c).alias(f"p_{c}") for c in fields]), "n").alias("p"), F.count("*").alias("all")).select("b", "all", "p.*"), "sfx-pivots")
        got = materialize(_parted(join_hot(many, pivot, ["b"], [*KEY, "pos"], "all"), length, gram), "sfx-parted")
        found.append(got.where("b is null").select(*KEY, F.col("x").alias("lo"), F.col("y").alias("hi")))
        rest = got.where("b is not null").select(*KEY, "pos", "b", F.col("x").alias("cl"), F.col("y").alias("cr"))
        again = materialize(rest.groupBy("b").agg(F.count("*").alias("all")).where("`all` > 1").select("b", "all", (F.col("all") > CROWD).alias("crowd")), "sfx-again")
        texts = contexts.where("crowd").select(*fields)  # one row for each place
        met = join_hot(rest, again, ["b"], [*KEY, "pos"], "all").drop("all")
        new = materialize(met.join(texts, [*KEY, "pos"]).select("b", "cl", "cr", "crowd", *fields), "sfx-now")
        for old in (own, pivot, again):
            discard(old)
        now = own = new


def _cut(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, carry: bool = False) -> DataFrame:
    """Texts with the spans to remove: ``row`` (the columns of ``docs`` but text), n_bytes, sha, text, spans.

    Where nothing can go, text is null and sha that of the whole text, unless
    ``carry`` keeps all texts.
    """
    base = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row"), text_or_empty().alias("text"))
    base = base.withColumns({"key": F.xxhash64("row", "text"), "twin": F.xxhash64(F.lit(1), "row", "text")})
    rows = _anchor_rows(base.where(F.octet_length("text") >= length), length, gram)
    alike = (F.min("u") == F.max("u")) & (F.min("v") == F.max("v"))
    grams = rows.groupBy("g").agg(F.count("*").alias("n"), alike.alias("alike")).where("n > 1")
    grams = materialize(grams, "sfx-grams")
    met = materialize(join_hot(rows, grams, ["g"], [*KEY, "pos"]).drop("n"), "sfx-anchors")
    place = ("twin", "pos", "left", "right")
    kinds = met.where("not alike").groupBy("g", "u", "v").agg(F.count("*").alias("n"), F.max("key").alias("key"), *[F.max_by(c, "key").alias(c) for c in place])
    kinds = materialize(kinds, "sfx-kinds")
    crowd = materialize(kinds.groupBy("g").agg(F.count("*").alias("all")).select("g", "all", (F.col("all") > CROWD).alias("crowd")), "sfx-crowds")
    more = kinds.where("n > 1").select("g", "u", "v", "n")
    again = join_hot(met.where("not alike"), more, ["g", "u", "v"], [*KEY, "pos"]).select(*KEY, "pos", "left", "right")
    full = met.where("alike").select(*KEY, "pos", "left", "right").union(again)
    full = full.groupBy(*KEY).agg(F.collect_set(F.struct((F.col("pos") - F.col("left")).alias("lo"), (F.col("pos") + gram + F.col("right")).alias("hi"))).alias("full"))
    wanted = join_hot(kinds, crowd, ["g"], [*KEY, "pos"], "all").groupBy(*KEY).agg(F.collect_list(F.struct("g", "n", "pos", "left", "right", "crowd")).alias("wanted"))
    notes = materialize(full.join(wanted, KEY, "full"), "sfx-notes")
    for old in (met, grams, kinds, crowd):
        discard(old)
    some = F.col("full").isNotNull() | F.col("wanted").isNotNull()
    texts = base.join(notes, KEY, "left").select(
        *KEY, "row", "full", "wanted", F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.when(~some, F.sha2(F.col("text").cast("binary"), 256)).alias("sha"),
        F.when(some | F.lit(carry), F.col("text")).alias("text"),
    )
    texts = materialize(texts, "sfx-texts")
    discard(notes)
    contexts = materialize(_contexts(texts.where("wanted is not null"), length, gram), "sfx-contexts")
    more = reduce(DataFrame.union, _spans(contexts, length, gram))
    more = materialize(more.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("more")), "sfx-more")
    empty = F.array().cast("array<struct<lo: bigint, hi: bigint>>")
    done = texts.where("wanted is null").select("row", "n_bytes", "sha", "text", F.coalesce("full", empty).alias("spans"))
    both = F.concat(F.coalesce("full", empty), F.coalesce("more", empty))
    return texts.where("wanted is not null").join(more, KEY, "left").select("row", "n_bytes", "sha", "text", both.alias("spans")).union(done)


def digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """What is left of each document (doc_id, text) once repeated bytes are removed.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256. A null text is
    empty. Repeated rows are documents of their own and so repeat each other; a
    null doc_id is kept. An empty table gives no rows; other columns are not
    read. Texts of any length are worked whole: a task holds one text and the
    anchors of about ``flat.BLOCK`` bytes, or of one longer text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, count, sha = [], [], []
            for own, text, spans in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
                if not text.is_valid:
                    removed.append(0), count.append(0), sha.append(own.as_py())
                    continue
                raw, cut = text.as_buffer().to_pybytes(), _cut([(s["lo"], s["hi"]) for s in spans])
                h, at = hashlib.sha256(), 0
                for a, b in cut:
                    h.update(raw[at:a])
                    at = b
                h.update(raw[at:])
                removed.append(sum(b - a for a, b in cut)), count.append(len(cut)), sha.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = removed_spans(docs.select("doc_id", "text"), length, gram)
    return map_arrow(found.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "sha", "text", "spans"), run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents, all columns, with repeated bytes cut out of ``text``.

    Bytes of a character that is cut in part go with it, so what is left is
    valid UTF-8. Nulls and repeated rows as in ``digest``; a null text stays null.
    """
    null = "__null_text"
    keyed = docs.withColumn(null, F.col("text").isNull())
    found = removed_spans(keyed, length, gram, carry=True).select("row", "text", "spans")
    row = found.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                if not spans:
                    out.append(text.as_py())
                    continue
                raw, at, part = text.as_buffer().to_pybytes(), 0, []
                for a, b in [*_cut([(s["lo"], s["hi"]) for s in spans]), (len(text.as_buffer()), 0)]:
                    part.append(raw[at:a].decode(errors="ignore"))
                    at = b
                out.append("".join(part))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "text"])

    cut = map_arrow(found, run, f"row {row}, text string")
    return cut.select(*[F.when(~F.col(f"row.{null}"), F.col("text")).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
