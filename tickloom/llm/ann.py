"""Nearest neighbours by additive quantisation.

A vector is written as the sum of one codeword from each of M codebooks of the
full dimension. Codebooks start from k-means on residuals and are then solved
again by least squares for the codes that beam search finds. With the stored
norm of the sum, the distance to a query is M table lookups; the best by that
score are ranked again by exact distances of the original vectors. The length
of what the sum leaves over is stored too: by the triangle inequality it tells
which other rows may still be among the nearest, and all these get an exact
distance. So the result is exact, whatever the codes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, scratch, shared_dir
from .vectors import matrix, usable

#: The bounded sample that codebooks are fitted on; codebooks, their words, beam width.
FIT_ROWS, BOOKS, WORDS, BEAM = 4096, 8, 256, 4
#: Bytes of the queries that are sent to the executors at once; rows that a task scores at once, and how many of them get exact distances first, to have a bound for the rest.
BLOCK_BYTES, ROWS, FIRST = 4 << 20, 4096, 64
NEAR = "query_id bigint, vec_id bigint, score double"


class Codebooks:
    """M codebooks of full dimension."""

    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)  # M, K, d
        m, k, d = books.shape
        flat = self.books.reshape(m * k, d)
        self.gram = (flat @ flat.T).reshape(m, k, m, k)

    @classmethod
    def fit(cls, x: np.ndarray, m: int = BOOKS, k: int = WORDS, beam: int = BEAM, rounds: int = 2, seed: int = 7) -> Codebooks:
        rng = np.random.default_rng(seed)
        x = x.astype(np.float32)
        k = max(1, min(k, len(x)))
        rest, books = x.copy(), []
        for _ in range(m):
            c = rest[rng.choice(len(x), k, replace=False)].copy()
            for _ in range(6):
                at = np.argmin((c * c).sum(1) - 2 * rest @ c.T, axis=1)
                n = np.bincount(at, minlength=k)
                total = np.zeros_like(c)
                np.add.at(total, at, rest)
                c[n > 0] = total[n > 0] / n[n > 0, None]
            rest = rest - c[np.argmin((c * c).sum(1) - 2 * rest @ c.T, axis=1)]
            books.append(c)
        out = cls(np.array(books))
        for _ in range(rounds):
            codes = out.encode(x, beam)
            now = out.books.reshape(m * k, -1)
            normal, right = np.eye(m * k, dtype=np.float32), np.zeros_like(now)
            for s in range(0, len(x), 1024):
                part = codes[s : s + 1024]
                hot = np.zeros((len(part), m * k), np.float32)
                hot[np.arange(len(part))[:, None], part + np.arange(m) * k] = 1
                normal += hot.T @ hot
                right += hot.T @ (x[s : s + 1024] - hot @ now)
            out = cls((now + np.linalg.solve(normal, right)).reshape(m, k, -1))
        return out

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes by beam search over the codebooks in turn: the ``beam`` best sums so far are kept."""
        m, k, d = self.books.shape
        out = np.zeros((len(x), m), np.int64)
        norms = (self.books**2).sum(2)
        for s in range(0, len(x), 2048):
            part = x[s : s + 2048].astype(np.float32)
            n = len(part)
            dots = np.einsum("nd,mkd->nmk", part, self.books, optimize=True)
            cost, codes = np.zeros((n, 1), np.float32), np.zeros((n, 1, m), np.int64)
            for b in range(m):
                step = cost[:, :, None] + (norms[b] - 2 * dots[:, b])[:, None, :]
                for a in range(b):  # the sum so far, against each word
                    step += 2 * self.gram[a, codes[:, :, a], b]
                flat = step.reshape(n, -1)
                keep = min(beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                cost = np.take_along_axis(flat, best, 1)
                codes = np.take_along_axis(codes, (best // k)[:, :, None], 1)
                codes[:, :, b] = best % k
            out[s : s + n] = codes[np.arange(n), np.argmin(cost, axis=1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(self.books.shape[0]), codes].sum(1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """q . word for each query, codebook and word."""
        return np.einsum("qd,mkd->qmk", q.astype(np.float32), self.books, optimize=True)


def _fit(rows: DataFrame, sample: int) -> Codebooks | None:
    """Fit on at most ``sample`` vectors, those with the least hash of the id."""
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()
    return Codebooks.fit(np.array([r[0] for r in got])) if got else None


def index(rows: DataFrame, books: Codebooks) -> DataFrame:
    """Codes and the stored norm of the coded vector for every row (vec_id, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column(1))
            codes = books.encode(x)
            coded = books.decode(codes)
            norm = (coded**2).sum(1)
            rest = np.sqrt(((x - coded) ** 2).sum(1))
            m = codes.shape[1]
            cols = [*batch.columns, pa.FixedSizeBinaryArray.from_buffers(pa.binary(m), len(batch), [None, pa.py_buffer(codes.astype(np.uint8).tobytes())]).cast(pa.binary()), pa.array(norm.astype(np.float32)), pa.array(rest)]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "embedding", "codes", "norm", "rest"])

    return map_arrow(rows, run, "vec_id bigint, embedding array<double>, codes binary, norm float, rest double")


def _merge(best: list[np.ndarray], vec: np.ndarray, x: np.ndarray, rows: np.ndarray, own: int, query: np.ndarray, k: int) -> list[np.ndarray]:
    """The k nearest (ids, distances, nearest first) of those so far and these rows, the query's own id left out; ties go to the smaller id."""
    rows = rows[vec[rows] != own]
    d = np.concatenate((best[1], np.sqrt(((x[rows] - query) ** 2).sum(1))))
    v = np.concatenate((best[0], vec[rows]))
    order = np.lexsort((d, v))
    v, d = v[order], d[order]
    first = np.ones(len(v), bool)  # a repeated id counts once, by its nearest row
    first[1:] = v[1:] != v[:-1]
    v, d = v[first], d[first]
    keep = np.lexsort((v, d))[:k]
    return [v[keep], d[keep]]


def _search(table: DataFrame, books: Codebooks, send, k: int) -> DataFrame:
    """For each query of a block the k nearest of each partition."""
    reach = float(np.sqrt((books.books.astype(np.float64) ** 2).sum(2)).max(1).sum())  # no sum of words is longer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, queries = send.value
        fuzz = (queries.shape[1] + books.books.shape[0]) * 2.0**-22  # of 32-bit sums
        length = np.sqrt((queries**2).sum(1))
        best: list[list[np.ndarray]] = [[np.zeros(0, np.int64), np.zeros(0)] for _ in own]
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                n = len(part)
                vec, x = part.column(0).to_numpy(), matrix(part.column(1))
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(n, -1).T
                norm, rest = part.column(3).to_numpy(), part.column(4).to_numpy()
                square = (x * x).sum(1)
                top, at = min(n, max(k + 1, FIRST)), np.arange(len(codes))[:, None]
                for i in range(len(own)):
                    if not i % 64:
                        lut = books.tables(queries[i : i + 64])
                    score = norm - 2 * lut[i % 64][at, codes].sum(0)
                    near = np.argpartition(score, top - 1)[:top] if top < n else np.arange(n)
                    best[i] = _merge(best[i], vec, x, near, own[i], queries[i], k)
                    if top == n:
                        continue
                    # rows that the codes can't rule out: distance to the sum of words, less what that leaves over, within the k-th so far
                    worst = best[i][1][-1] if len(best[i][1]) == k else np.inf
                    slack = fuzz * (reach + length[i]) ** 2
                    out = np.sqrt(np.maximum(score + length[i] ** 2 - slack, 0)) - rest * (1 + 1e-9) - fuzz * reach > worst
                    out[near] = True
                    more = np.flatnonzero(~out)
                    if len(more) > top:  # and of many, those that 64-bit products can't
                        far = square[more] - 2 * x[more] @ queries[i] + length[i] ** 2 - 1e-11 * (np.sqrt(square[more]) + length[i]) ** 2 > worst**2
                        more = more[~far]
                    if len(more):
                        best[i] = _merge(best[i], vec, x, more, own[i], queries[i], k)
        size = [len(b[0]) for b in best]
        if sum(size):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, size)), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))], names=["query_id", "vec_id", "score"])

    return map_arrow(table.select("vec_id", "embedding", "codes", "norm", "rest"), run, NEAR)


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, sample: int = FIT_ROWS) -> DataFrame:
    """The k nearest rows by Euclidean distance for each row whose vec_id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score; fewer rows where there are
    fewer candidates. Vectors that are null, zero, hold null or non-finite
    components or have no vec_id take no part. Candidates of a query are the
    vectors of its length, as no distance to others is defined; each length has
    an index of its own. A repeated vec_id counts once, by its nearest
    row; the first of repeated queries is used. Ties go to the smaller vec_id.
    Every row is coded and scored for every query, by blocks of queries of at
    most ``BLOCK_BYTES``: one pass over the table each, whose broadcast is
    destroyed and whose result is written before the next begins, so neither
    the plan nor the driver grows with the queries. The result is exact and
    doesn't depend on batches.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable()).select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    path = f"{shared_dir(spark)}/tickloom/ann-near-{uuid.uuid4().hex}"
    asked = rows.where(F.col("vec_id") % every == 0)
    for r in asked.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect():  # lengths of queries
        _nearest(rows.where(F.size("embedding") == r["d"]), r["d"], k, every, sample, path)
    spark.createDataFrame([], NEAR).write.mode("append").parquet(path)
    near = scratch(spark, path, NEAR)
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    one = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(rows: DataFrame, dim: int, k: int, every: int, sample: int, path: str) -> None:
    """Append the nearest of each partition for all queries of one length."""
    spark = rows.sparkSession
    books = _fit(rows, sample)
    table = materialize(index(rows, books), "ann-index")
    asked = materialize(table.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "ann-queries")
    n = -(-asked.count() // max(1, BLOCK_BYTES // (8 * dim)))
    for b in range(n):
        got = sorted(asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == b).collect())
        if got:
            send = spark.sparkContext.broadcast((np.array([r[0] for r in got]), np.array([r[1] for r in got])))
            _search(table, books, send, k).write.mode("append").parquet(path)
            send.destroy()
    for old in (asked, table):
        discard(old)
