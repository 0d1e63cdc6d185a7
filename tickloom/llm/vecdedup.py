"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector is padded, rotated at random and kept as the signs of its
coordinates with a correction factor, the inner product of the vector and its
code. Divided by it, the product of one vector's code and another vector is an
unbiased estimate of their cosine with a known error; only pairs whose upper
confidence bound reaches the threshold are computed exactly. Bands of code bits
choose the pairs to look at: so many that a pair at the threshold misses all
bands with a chance below ``MISS``. Equal vectors are one row with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, join_hot, map_arrow, materialize
from .vectors import matrix, usable

#: Length of the codes, chance that a pair at the threshold shares no band, width of the confidence bound in standard errors.
BITS, MISS, SIGMAS = 1024, 1e-4, 5.0
#: Rows of a bucket that one tile holds; larger buckets are cut into chunks and every two chunks meet in a tile.
TILE = 2048


def rotation(dim: int, bits: int = BITS, seed: int = 11) -> np.ndarray:
    """The first ``dim`` columns of blocks of random rotations: dim x bits, rows of unit length."""
    rng = np.random.default_rng(seed)
    wide = max(bits, dim)
    q, _ = np.linalg.qr(rng.standard_normal((wide, dim)))
    return q.T  # the padded coordinates are zero, so the other columns never matter


def plan(largest: int, cosine: float) -> tuple[int, int]:
    """Bits of a band and number of bands for labels of at most so many rows; bands narrow until as many as needed fit in the code."""
    agree = 1 - math.acos(cosine) / math.pi

    def bands(width: int) -> int:
        lost = 1 - agree**width
        return math.ceil(math.log(MISS) / math.log(lost)) if 0 < lost < 1 else 1 if lost <= 0 else BITS + 1

    width = int(np.clip(round(math.log2(max(largest, 1) / 64)), 4, 20))
    while width * bands(width) > BITS:  # down to 0 bits: one bucket that holds all
        width -= 1
    return width, bands(width)


def codes(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors, their signs, and the correction factors."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    o = (unit @ turn).astype(np.float32)
    signs = np.where(o >= 0, np.float32(1), np.float32(-1)) / np.float32(math.sqrt(turn.shape[1]))
    return o, signs, (o * signs).sum(1)


def band_keys(o: np.ndarray, width: int, bands: int) -> np.ndarray:
    bits = (o[:, : width * bands] >= 0).reshape(len(o), bands, width)
    return bits @ (1 << np.arange(width))


def links(x: np.ndarray, keys: np.ndarray, band: int, across: bool, chunk: np.ndarray, turn: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j) of one tile whose first common band is this one; in a tile of two chunks only pairs across them."""
    o, signs, factor = codes(x, turn)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    slack = SIGMAS * np.sqrt(np.maximum(1 - factor**2, 0)) / (factor * math.sqrt(turn.shape[1] - 1))
    left, right = [], []
    for s in range(0, len(x), 512):
        about = (signs[s : s + 512] @ o.T) / factor[s : s + 512, None] + slack[s : s + 512, None]
        i, j = np.nonzero(about >= cosine - 1e-6)
        i = i + s
        keep = (chunk[i] < chunk[j]) if across else (i < j)
        i, j = i[keep], j[keep]
        for t in range(0, len(i), 1 << 16):
            a, b = i[t : t + (1 << 16)], j[t : t + (1 << 16)]
            same = keys[a] == keys[b]
            first = same[:, band] & (np.argmax(same, axis=1) == band)
            a, b = a[first], b[first]
            yes = (unit[a] * unit[b]).sum(1) >= cosine
            left.append(a[yes])
            right.append(b[yes])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _star(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each row the least row that it is joined to by the pairs."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _tiles(turn: np.ndarray, width: int, bands: int, cosine: float):
    """Work the tiles of sorted rows (tile, band, tag, across, chunk, id, weight, embedding): each row's links and its least neighbour in the tile.

    ``tile`` is a hash; rows of one tile that differ in band or label (tag) are worked apart.
    """

    def one(band: int, across: bool, chunk: np.ndarray, ids: np.ndarray, weight: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        keys = band_keys((x / np.linalg.norm(x, axis=1, keepdims=True) @ turn).astype(np.float32), width, bands)
        i, j = links(x, keys, band, across, chunk, turn, cosine)
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, i, weight[j])
        np.add.at(count, j, weight[i])
        order = np.argsort(ids, kind="stable")
        at = np.empty(len(ids), np.int64)
        at[order] = np.arange(len(ids))
        low = ids[order][_star(len(ids), at[i], at[j])][at]
        keep = count > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(count[keep]), pa.array(low[keep])], names=["id", "links", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                if len(t) > 1:
                    yield one(t["band"][0].as_py(), t["across"][0].as_py(), t["chunk"].to_numpy(), t["id"].to_numpy(), t["weight"].to_numpy(), matrix(t["embedding"]))
                held.clear()

        last = None
        for batch in batches:
            tile, band, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.array(batch.column(2).to_pylist(), object)
            if not len(tile):
                continue
            new = (tile[1:] != tile[:-1]) | (band[1:] != band[:-1]) | (tag[1:] != tag[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(tile)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if last is not None and (tile[a], band[a], tag[a]) != last:
                    yield from flush()
                held.append(batch.slice(a, b - a))
                last = tile[a], band[a], tag[a]
        yield from flush()

    return run


def duplicates(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """Near-duplicates among rows (vec_id, embedding, label) of equal, non-null label.

    Returns one row for each input row: vec_id, n_links (other rows linked to
    it), component_id (smallest vec_id reachable by links, itself included),
    kept (vec_id = component_id). Vectors that are null, zero, or hold null or
    non-finite components, rows without label or vec_id, link with nothing
    (n_links 0, component_id = vec_id). Vectors of different length never link.
    Repeated rows are rows that link with each other; different vectors that
    share a vec_id are different nodes, each with links of its own. An empty
    table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("label").alias("label"), "embedding", usable().alias("fine"))
    rows = rows.withColumn("fine", F.col("fine") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    reps = rows.where("fine").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    reps = materialize(reps.withColumn("id", F.monotonically_increasing_id()), "vec-reps")  # numbered once, as it is written
    shapes = reps.groupBy(F.size("embedding").alias("d"), "label").count().groupBy("d").agg(F.max("count").alias("most")).orderBy("d").collect()  # a row for each length of vectors
    found = None
    for shape in shapes:
        part = _links(reps.where(F.size("embedding") == shape["d"]), shape["d"], shape["most"], cosine)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "id bigint, links bigint, low bigint")
    found = materialize(found, "vec-links")
    comp = components(found.select(F.col("id").alias("src"), F.col("low").alias("dst")), "vec-cc")
    total = found.groupBy("id").agg(F.sum("links").alias("links"))
    numbered = materialize(reps.select("id", "least").join(comp, "id", "left").select("id", "least", F.coalesce("component", "id").alias("root")), "vec-roots")
    lowest = numbered.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n"))
    of = join_hot(numbered, materialize(lowest, "vec-lowest"), ["root"], ["id"]).select("id", "component")
    node = materialize(reps.join(total, "id", "left").join(of, "id").select("label", "embedding", F.coalesce("links", F.lit(0)).alias("links"), "weight", "component"), "vec-nodes")
    for old in (found, numbered):
        discard(old)
    on = (rows.label == node.label) & (rows.embedding == node.embedding) & rows.fine
    return rows.join(node, on, "left").select(
        "vec_id",
        F.coalesce(node.links + node.weight - 1, F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce(node.component, rows.vec_id).alias("component_id"),
        F.coalesce(F.coalesce(node.component, rows.vec_id) == rows.vec_id, F.lit(True)).alias("kept"),
    )


def _links(reps: DataFrame, dim: int, largest: int, cosine: float) -> DataFrame:
    """Links of distinct vectors of one length: id, links, low for each row and tile."""
    turn = rotation(dim)
    width, bands = plan(largest, cosine)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = matrix(batch.column(1), dim)
                k = band_keys((x / np.linalg.norm(x, axis=1, keepdims=True) @ turn).astype(np.float32), width, bands)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(k), pa.list_(pa.int64()))], names=["id", "keys"])

    each = map_arrow(reps.select("id", "embedding"), keys, "id bigint, keys array<bigint>")
    each = materialize(each.join(reps.select("id", "label", "weight", "embedding"), "id"), "vec-keys")
    banded = each.select("id", "label", F.posexplode("keys").alias("band", "key"))
    large = materialize(banded.groupBy("label", "band", "key").agg(F.count("*").alias("n")).where("n > 1"), "vec-buckets")
    full = each.select("id", "label", "weight", "embedding", F.posexplode("keys").alias("band", "key"))
    n = F.ceil(F.col("n") / TILE).cast("int")
    chunk = F.pmod(F.xxhash64("id"), n).cast("int")
    cut = join_hot(full, large, ["label", "band", "key"], ["id"]).select("id", "weight", "embedding", "band", "label", "key", n.alias("n"), chunk.alias("chunk"))
    tiles = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    tile = F.xxhash64("label", "band", "key", F.least("chunk", "other"), F.greatest("chunk", "other"))
    rows = tiles.select(tile.alias("tile"), F.col("band").cast("int").alias("band"), F.col("label").cast("string").alias("tag"), (F.col("chunk") != F.col("other")).alias("across"), "chunk", "id", "weight", "embedding")
    return map_arrow(rows.repartition("tile").sortWithinPartitions("tile", "band", "tag"), _tiles(turn, width, bands, cosine), "id bigint, links bigint, low bigint")
