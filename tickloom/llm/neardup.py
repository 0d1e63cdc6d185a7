"""Near-duplicate documents by ProbMinHash.

A text is the multiset of its five-word shingles, a weight for each distinct
one. Each shingle is a Poisson process whose rate is its weight; every arrival
falls into one of M registers, which keeps the earliest. Only processes whose
next arrival can still lower a register go on, so the work ends early. Two
texts agree in a register with the probability Jaccard similarity of their
weights. Registers are cut into bands; texts that share a band are candidates,
and each link is verified by the exact probability Jaccard similarity.

Equal multisets are first reduced to one representative. In a band's bucket
every text meets the bucket's leader, and then, if it is still in another
component, a second leader. Buckets whose texts are then still in different
components are cut into chunks, every two chunks meet in a tile, and
a tile compares all its texts by matrix products (common shingles, or for texts
with repeated ones a bound, then exactly) and hands on a forest of the links
between components. So no pairs of a group are ever listed, and no link between components of a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, join_hot, map_arrow, materialize, text_or_empty
from .flat import blocks, mix, per_text, prefix, runs, span_hash

SHINGLE, BANDS, ROWS = 5, 24, 5
#: Texts of a chunk; columns of a matrix product.
TILE, COLUMNS = 512, 4096
_U = np.uint64


def _word_bytes() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = 1
    return t


WORD = _word_bytes()


def shingles(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of the (lower-case) texts of a block: hashes and counts, sorted by text and hash, and the bounds of each text's.

    A text of fewer than five words is one shingle of all of them; one without
    words has the shingle of its bytes.
    """
    start, end, _ = runs(WORD[buf], off)
    c = prefix(buf)
    w, bounds = span_hash(c, start, end), per_text(start, off)
    n = np.diff(bounds)
    size = np.maximum(n - SHINGLE + 1, 1)
    doc = np.repeat(np.arange(len(n)), size)
    first = np.cumsum(size) - size
    h = np.zeros(int(size.sum()), np.uint64)
    at = np.arange(len(h)) - np.repeat(first, size) + np.repeat(bounds[:-1], size)
    full = np.repeat(n >= SHINGLE, size)
    for i in range(SHINGLE):
        h[full] = mix(h[full] * _U(0x9E3779B97F4A7C15) + w[at[full] + i])
    for k in np.flatnonzero(n < SHINGLE):
        x = span_hash(c, off[k : k + 1], off[k + 1 : k + 2]) if n[k] == 0 else n[k : k + 1].astype(np.uint64)
        for i in range(bounds[k], bounds[k + 1]):
            x = mix(x * _U(3) + w[i : i + 1])
        h[first[k]] = x[0]
    order = np.argsort(doc.astype(np.uint64) << _U(48) | h >> _U(16))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    return h[at], count, np.searchsorted(doc[at], np.arange(len(n) + 1))


def registers(h: np.ndarray, weight: np.ndarray, bounds: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash registers (texts x m): the shingle with the earliest arrival in each."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    when, who = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    t, live = np.zeros(len(h)), np.arange(len(h))
    k = 0
    while len(live):
        k += 1
        x = mix(h[live] + _U(k * 0xD1342543DE82EF95 & (1 << 64) - 1))
        t[live] -= np.log1p(-(x >> _U(11)).astype(np.float64) * 2.0**-53) / weight[live]
        slot = doc[live] * m + (mix(x + _U(0x632BE59BD9B4E019)) % _U(m)).astype(np.int64)
        low = t[live] < when[slot]
        a, s = live[low], slot[low]
        np.minimum.at(when, s, t[a])
        won = t[a] == when[s]
        who[s[won]] = h[a[won]]
        limit = when.reshape(n, m).max(1)
        live = live[t[live] < limit[doc[live]]]
    return who.reshape(n, m)


def _print(h: np.ndarray, count: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each multiset."""
    c = count.astype(np.uint64)
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        x = np.concatenate(([_U(0)], np.cumsum(mix(h * _U(salt) + c))))
        out.append((x[bounds[1:]] - x[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, two fingerprints of the text's multiset of shingles, and its band hashes."""
    kind = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in blocks(pc.utf8_lower(batch.column(1))):
                h, count, bounds = shingles(buf, off)
                who = registers(h, count.astype(np.float64), bounds)
                band = np.zeros((j - i, BANDS), np.uint64)
                for r in range(ROWS):
                    band = mix(band * _U(0x9E3779B97F4A7C15) + who.reshape(j - i, BANDS, ROWS)[:, :, r])
                to = pa.array(np.arange(0, (j - i + 1) * BANDS, BANDS, dtype=np.int32))
                f1, f2 = _print(h, count, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(f1), pa.array(f2), pa.ListArray.from_arrays(to, pa.array(band.reshape(-1).view(np.int64)))], schema=schema)

    return map_arrow(docs, run, "doc_id bigint, f1 bigint, f2 bigint, bands array<bigint>")


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, f1, f2 and the sorted shingles with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in blocks(pc.utf8_lower(batch.column(1))):
                h, count, bounds = shingles(buf, off)
                f1, f2 = _print(h, count, bounds)
                to = pa.array(bounds.astype(np.int32))
                lists = [pa.ListArray.from_arrays(to, pa.array(x)) for x in (h.view(np.int64), count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(f1), pa.array(f2), *lists], names=["doc_id", "f1", "f2", "sh", "n"])

    return map_arrow(docs, run, "doc_id bigint, f1 bigint, f2 bigint, sh array<bigint>, n array<int>")


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact similarity of two weighted sets (distinct hashes, weights): the sum over common d of 1 / sum over all e of max(x_e / x_d, y_e / y_d)."""
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if (x == x[0]).all() and (y == y[0]).all():  # plain sets
        return len(common) / (len(a) + len(b) - len(common))
    p, q = x[i].astype(float), y[j].astype(float)
    only_a, only_b = float(x.sum() - p.sum()), float(y.sum() - q.sum())
    ratio = q / p
    order = np.argsort(ratio, kind="stable")
    p, q, ratio = p[order], q[order], ratio[order]
    before = np.concatenate(([0.0], np.cumsum(p)))
    after = q.sum() - np.concatenate(([0.0], np.cumsum(q)))
    upto = np.searchsorted(ratio, ratio, "right")  # of equal ratios both sides agree
    return float((1 / ((before[upto] + only_a) / p + (after[upto] + only_b) / q)).sum())


def _verify(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(src, dst, same): whether each pair (a written table) of representatives reaches the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, x, b, y = (batch.column(k) for k in range(2, 6))
            same = [probability_jaccard(a[k].values.to_numpy(), x[k].values.to_numpy(), b[k].values.to_numpy(), y[k].values.to_numpy()) >= least for k in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.bool_())], names=["src", "dst", "same"])

    both = pairs
    for side, i in (("src", 1), ("dst", 2)):  # a leader stands in as many pairs as its buckets have texts
        times = materialize(pairs.groupBy(side).agg(F.count("*").alias("times")), "dup-times")
        own = times.join(sets.select(F.col("doc_id").alias(side), F.col("sh").alias(f"sh{i}"), F.col("n").alias(f"n{i}")), side)
        both = join_hot(both, own, [side], ["src", "dst"], "times", counts=times).drop("times")
    return map_arrow(both.select("src", "dst", "sh1", "n1", "sh2", "n2"), run, "src bigint, dst bigint, same boolean")


def _tile_links(h: list[np.ndarray], weight: list[np.ndarray | None], comp: np.ndarray, chunk: np.ndarray, across: bool, least: float) -> list[tuple[int, int]]:
    """Pairs of texts of a tile that reach the similarity: a forest over components (numbered from 0), for pairs that it has joined need no more links."""
    n = len(h)
    size = np.fromiter(map(len, h), np.int64, n)
    flat, doc = np.concatenate(h), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, doc = flat[order], doc[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    col = np.cumsum(new) - 1
    shared = np.bincount(col)[col] > 1
    col, doc = np.unique(col[shared], return_inverse=True)[1], doc[shared]
    common = np.zeros((n, n), np.float32)
    for a in range(0, int(col.max(initial=-1)) + 1, COLUMNS):
        i, j = np.searchsorted(col, (a, a + COLUMNS))
        m = np.zeros((n, COLUMNS), np.float32)
        m[doc[i:j], col[i:j] - a] = 1
        common += m @ m.T
    apart = comp[:, None] != comp[None, :]
    apart &= (chunk[:, None] < chunk[None, :]) if across else (np.arange(n)[:, None] < np.arange(n)[None, :])
    plain = np.array([w is None for w in weight])
    both = plain[:, None] & plain[None, :]
    same = common / (size[:, None] + size[None, :] - common) >= least
    i, j = np.nonzero(apart & both & same)
    code = np.unique(np.minimum(comp[i], comp[j]).astype(np.int64) * n + np.maximum(comp[i], comp[j]), return_index=True)[1]
    pairs = [(a, b, True) for a, b in zip(i[code].tolist(), j[code].tolist(), strict=True)]
    if not plain.all():
        # no term of probability Jaccard exceeds the lesser of the two shares, which does not exceed the root of their product
        part = np.concatenate([np.sqrt((w if w is not None else np.ones(k)) / (w.sum() if w is not None else k)) for w, k in zip(weight, size.tolist(), strict=True)])[order][shared].astype(np.float32)
        bound = np.zeros((n, n), np.float32)
        for a in range(0, int(col.max(initial=-1)) + 1, COLUMNS):
            i, j = np.searchsorted(col, (a, a + COLUMNS))
            m = np.zeros((n, COLUMNS), np.float32)
            m[doc[i:j], col[i:j] - a] = part[i:j]
            bound += m @ m.T
        i, j = np.nonzero(apart & ~both & (bound >= least - 1e-4))
        pairs += [(a, b, False) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    low = list(range(int(comp.max(initial=-1)) + 1))

    def root(x: int) -> int:
        while low[x] != x:
            low[x] = x = low[low[x]]
        return x

    out = []
    for a, b, sure in pairs:
        s, t = root(comp[a]), root(comp[b])
        if s == t:
            continue
        x, y = (weight[k] if weight[k] is not None else np.ones(size[k]) for k in (a, b))
        if sure or probability_jaccard(h[a], x, h[b], y) >= least:
            low[s] = t
            out.append((a, b))
    return out


def _tiles(least: float):
    """Work tiles of sorted rows (tile, across, chunk, rep, component, sh, n)."""

    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(held).combine_chunks()
        comp = np.unique(t["component"].to_numpy(), return_inverse=True)[1]
        if len(comp) < 2 or comp.max() == 0:
            return None
        h = [np.unique(x.values.to_numpy()) if not w.is_valid else x.values.to_numpy() for x, w in zip(t["sh"], t["n"], strict=True)]
        pairs = _tile_links(h, [w.values.to_numpy() if w.is_valid else None for w in t["n"]], comp, t["chunk"].to_numpy(), t["across"][0].as_py(), least)
        ids = t["rep"].to_numpy()
        return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in pairs], pa.int64()), pa.array([ids[b] for _, b in pairs], pa.int64())], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            tile = batch.column(0).to_numpy()
            if not len(tile):
                continue
            cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if last is not None and tile[a] != last:
                    if (out := one(held)) is not None:
                        yield out
                    held = []
                held.append(batch.slice(a, b - a))
                last = tile[a]
        if held and (out := one(held)) is not None:
            yield out

    return run


def _ordered(df: DataFrame) -> DataFrame:
    return df.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def _classed(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The documents with an id, in classes: doc_id, f1, f2 (the text's fingerprints), copy_of, class_id and component, a number of the class; and the input with a bigint id and no null text.

    Nodes are numbered texts (multisets of shingles), not ids, so different
    texts that share an id link each by itself.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text"))
    sig = materialize(signatures(docs.where("doc_id is not null")), "dup-signatures")
    ids = materialize(sig.groupBy("f1", "f2").agg(F.min("doc_id").alias("low")).withColumn("rep", F.monotonically_increasing_id()), "dup-reps")
    own = sig.join(ids, ["f1", "f2"])
    banded = materialize(
        own.where("doc_id = low").select("rep", F.posexplode("bands").alias("band", "key")).select("rep", F.xxhash64("band", "key").alias("key")).distinct(), "dup-bands"
    )
    buckets = materialize(banded.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("leader")).where("n > 1"), "dup-buckets")
    member = materialize(join_hot(banded, buckets, ["key"], ["rep"]).select("key", "rep"), "dup-members")
    wanted = ids.join(member.select("rep").distinct(), "rep").select(F.col("low").alias("doc_id"), "f1", "f2", "rep")
    some = _sets(docs.join(wanted.select("doc_id").distinct(), "doc_id")).join(wanted, ["f1", "f2", "doc_id"])
    sets = materialize(some.dropDuplicates(["rep"]).select(F.col("rep").alias("doc_id"), "sh", "n"), "dup-sets")
    discard(banded)

    at = member.withColumn("component", F.col("rep"))
    found: DataFrame | None = None
    for of in (F.min_by, F.max_by):
        leaders = at.groupBy("key").agg(F.count("*").alias("n"), of("rep", "component").alias("leader"), (F.min("component") < F.max("component")).alias("mixed"), of("component", "component").alias("lead"))
        leaders = materialize(leaders.where("mixed").drop("mixed"), "dup-leaders")
        met = join_hot(at, leaders, ["key"], ["rep"]).where("component <> lead")
        pairs = materialize(_ordered(met.select(F.col("rep").alias("src"), F.col("leader").alias("dst"))), "dup-pairs")
        same = _verify(pairs, sets, least).where("same").select("src", "dst")
        now = materialize(same if found is None else found.union(same), "dup-checked")
        comp = components(now, "dup-cc")
        new = materialize(member.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component")), "dup-at")
        for old in (leaders, pairs, found, at, comp):
            discard(old)
        at, found = new, now
    mixed = materialize(at.groupBy("key").agg(F.count("*").alias("n"), (F.min("component") < F.max("component")).alias("mixed")).where("mixed and n > 2").select("key", "n"), "dup-mixed")  # of two, both have met
    parts = F.ceil(F.col("n") / TILE).cast("int")
    chunk = F.pmod(F.xxhash64("rep"), parts).cast("int")
    tiles = join_hot(at, mixed, ["key"], ["rep"]).select("key", "rep", "component", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    tile = F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other"))
    short = sets.select(F.col("doc_id").alias("rep"), "sh", F.when(F.exists("n", lambda x: x > 1), F.col("n")).alias("n"))
    rows = tiles.select(tile.alias("tile"), (F.col("chunk") != F.col("other")).alias("across"), "chunk", "rep", "component").join(short, "rep").select("tile", "across", "chunk", "rep", "component", "sh", "n")
    linked = map_arrow(rows.repartition("tile").sortWithinPartitions("tile"), _tiles(least), "src bigint, dst bigint")
    now = materialize(found.union(_ordered(linked)), "dup-checked")  # tiles compare exactly
    comp = components(now, "dup-cc")
    for old in (at, mixed, found, now):
        discard(old)
    names = ids.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").select("f1", "f2", "low", F.coalesce("component", "rep").alias("component"))
    lows = names.groupBy("component").agg(F.min("low").alias("class_id"))
    out = sig.select("doc_id", "f1", "f2").join(names.join(lows, "component"), ["f1", "f2"])
    return out.select("doc_id", "f1", "f2", F.col("low").alias("copy_of"), "class_id", "component"), docs


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Classes of near-duplicates among documents (doc_id, text).

    Returns a row for each input row: doc_id, copy_of (smallest doc_id with the
    same shingles), class_id (smallest doc_id of its component of links), kept
    (doc_id = class_id). A null text is empty. Texts without words are copies
    only of texts with the same bytes; texts under five words are one shingle.
    Rows without doc_id link with nothing (class null, kept). Repeated rows
    have one class; different texts that share a doc_id are documents of their
    own, so each has its own class, though two classes may then have one
    smallest doc_id. An empty table gives no rows; other columns are not read.
    Texts of any length are worked whole.
    """
    classed, docs = _classed(docs, least)
    out = classed.select("doc_id", "copy_of", "class_id").withColumn("kept", F.col("doc_id") == F.col("class_id"))
    lost = docs.where("doc_id is null").select("doc_id", F.lit(None).cast("bigint").alias("copy_of"), F.lit(None).cast("bigint").alias("class_id"), F.lit(True).alias("kept"))
    return out.unionByName(lost)


def keep_one(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The documents, all columns, of which one of each class stays: that with the smallest doc_id.

    Different texts that share a doc_id are documents of their own. Where rows
    of a class share its smallest doc_id, one text of them stays: the one of
    least fingerprint, then the least text, then the least row by its hash.
    Rows without doc_id stay all; a null text is empty and stays null; texts of
    any length are compared whole; an empty table gives an empty one.
    """
    classed = materialize(_classed(docs, least)[0], "dup-classed")
    chosen = materialize(classed.groupBy("component").agg(F.min(F.struct("doc_id", "f1", "f2")).alias("k")).select("k.*"), "dup-chosen")
    shared = materialize(classed.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1"), "dup-shared")
    kept = docs.join(chosen.join(shared, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    if shared.limit(1).count():
        rows = docs.join(shared.join(chosen.select("doc_id"), "doc_id", "left_semi").select("doc_id"), "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"))
        rows = materialize(rows.withColumns({"id": F.monotonically_increasing_id(), "hash": F.xxhash64("row")}), "dup-rows")
        prints = signatures(rows.select(F.col("id").alias("doc_id"), F.coalesce("row.text", F.lit("")).alias("text"))).select(F.col("doc_id").alias("id"), "f1", "f2")
        own = rows.select("id", "hash", F.col("row.doc_id").cast("bigint").alias("doc_id"), F.col("row.text").alias("text"))
        one = own.join(prints, "id").join(chosen, ["doc_id", "f1", "f2"]).groupBy("doc_id", "f1", "f2").agg(F.min(F.struct("text", "hash", "id")).alias("least")).select("least.id")
        kept = kept.unionByName(rows.join(one, "id", "left_semi").select("row.*"))
    return kept.unionByName(docs.where("doc_id is null"))
