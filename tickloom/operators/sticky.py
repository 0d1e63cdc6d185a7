"""Sticky regime model: a hidden Markov chain over regimes whose scores are linear in the feature vector.

A quote takes the regimes' weights a to a T diag(p), p the softmax of its
scores and T the matrix of transitions. Those steps are 4 x 4 matrices, which
compose: chunks of them are multiplied and scaled, so no task follows a whole
symbol. The backward pass is the same scan over transposed steps in reverse
order. Training alternates both passes with sums over all rows; what reaches
the driver has the size of the model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import numbered, scan
from ..functions.stored import stored
from ..plans.registry import query
from ..sources.views import ticks
from .features import REGIME, REGIMES, features, regimes
from .vector import VECTOR, flatten, for_model, loaded

#: Chance that a regime stays, at the start; rounds of training; step of the scores' weights; prior counts of each transition and, besides, of staying.
STAY, ROUNDS, RATE, EACH, STICKY = 0.7, 3, 0.5, 1.0, 50.0
#: Rows of a chunk whose vectors are kept together, and of a block of it that numpy follows beside the others.
SPAN, BLOCK = 1024, 32
Scale = tuple[np.ndarray, np.ndarray] | None


def transitions(k: int = len(REGIMES), stay: float = STAY) -> np.ndarray:
    return np.full((k, k), (1 - stay) / max(k - 1, 1)) + np.eye(k) * (stay - (1 - stay) / max(k - 1, 1))


def _by(values: list[Column], total: Callable[[Column], Column]) -> Column:
    """The values as an array, divided by ``total`` of it."""
    return F.element_at(F.transform(F.array(F.array(*values)), lambda m: F.transform(m, lambda v: v / total(m))), 1)


def _sum(m: Column) -> Column:
    return F.aggregate(m, F.lit(0.0), lambda a, v: a + v)


def _then(k: int) -> Callable[[Column, Column], Column]:
    def then(f: Column, g: Column) -> Column:
        return _by([sum((f[i * k + j] * g[j * k + m] for j in range(1, k)), f[i * k] * g[m]) for i in range(k) for m in range(k)], F.array_max)

    return then


def _move(k: int) -> Callable[[Column, Column], Column]:
    def move(a: Column, f: Column) -> Column:
        return _by([sum((a[i] * f[i * k + m] for i in range(1, k)), a[0] * f[m]) for m in range(k)], _sum)

    return move


def forward(x: DataFrame, keys: list[str], likely: Sequence[str], t: np.ndarray) -> DataFrame:
    """Numbered rows with ``before`` and ``after``: the regimes' probabilities given the rows before, and with the row itself.

    ``likely`` are columns that say how likely each regime makes the row, up to
    a factor; one of them must be positive. A row with none positive or a null
    says nothing: all its regimes are as likely.
    """
    k = len(likely)
    start = F.array(*[F.lit(1.0 / k)] * k)
    x, p = _settled(x, likely)
    step = F.array(*[F.lit(float(t[i, j])) * p[j] for i in range(k) for j in range(k)])
    return scan(x, keys, step, _then(k), _move(k), start).drop(*[f"__p{i}" for i in range(k)])


def backward(x: DataFrame, keys: list[str], likely: Sequence[str], t: np.ndarray) -> DataFrame:
    """Numbered rows with ``later``: how likely each regime makes the rows after it, up to a factor."""
    k = len(likely)
    x, p = _settled(x, likely)
    last = x.groupBy(*keys).agg(F.max("n").alias("__last"))
    x = x.join(last, keys).withColumns({"__n": F.col("n"), "n": F.col("__last") + 1 - F.col("n")}).drop("__last")
    step = F.array(*[F.lit(float(t[j, i])) * p[i] for i in range(k) for j in range(k)])
    x = scan(x, keys, step, _then(k), _move(k), F.array(*[F.lit(1.0 / k)] * k))
    return x.withColumn("n", F.col("__n")).withColumnRenamed("before", "later").drop("__n", "after", *[f"__p{i}" for i in range(k)])


def _settled(x: DataFrame, likely: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    top = F.greatest(*likely)
    known = (top > 0) & (top < float("inf"))
    for c in likely:
        known &= F.col(c) >= 0
    x = x.withColumns({f"__p{i}": F.when(F.coalesce(known, F.lit(False)), F.col(c) / top).otherwise(1.0) for i, c in enumerate(likely)})
    return x, [F.col(f"__p{i}") for i in range(len(likely))]


def chunked(x: DataFrame, keys: list[str], chunk: int = SPAN) -> DataFrame:
    """Numbered rows with a ``vector`` as rows of (keys, chunk, rows): as many as ``chunk`` in the order of ``n``, written once. All rounds read them where they lie."""
    at = F.floor((F.col("n") - 1) / chunk).alias("chunk")
    return stored(x.groupBy(*keys, at).agg(F.array_sort(F.collect_list(F.struct("n", "vector"))).alias("rows")), "chunks").select(*keys, "chunk", F.col("rows.n").alias("n"), F.flatten("rows.vector").alias("values"))


@contextmanager
def _few(spark: SparkSession) -> Iterator[None]:
    """Chunks go to Python a few at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = spark.conf.get(key)
    spark.conf.set(key, "16")
    try:
        yield
    finally:
        spark.conf.set(key, had)


def _softmax(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    s = x @ weights[:, :-1].T + weights[:, -1]
    p = np.exp(s - s.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _steps(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The steps of a chunk's rows in blocks, (blocks, BLOCK, k, k); the last block is filled with steps that change nothing."""
    k = t.shape[0]
    known = np.isfinite(p).all(1, keepdims=True)
    full = np.tile(np.eye(k), (-(-len(p) // BLOCK) * BLOCK, 1, 1))
    full[: len(p)] = t[None] * np.where(known, p, 1.0)[:, None, :]
    return full.reshape(-1, BLOCK, k, k)


def _products(steps: np.ndarray) -> np.ndarray:
    """Each block's steps as one, up to a factor."""
    m = steps[:, 0]
    for j in range(1, steps.shape[1]):
        m = m @ steps[:, j]
        m = m / m.max((1, 2), keepdims=True)
    return m


def passes(p: np.ndarray, t: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Before, after and later of a chunk's rows, from the state before its first row and how likely what follows its last one is."""
    steps = _steps(p, t)
    blocks, k = len(steps), t.shape[0]
    whole = _products(steps)
    begin, end = np.empty((blocks, k)), np.empty((blocks, k))
    for i in range(blocks):
        begin[i] = first
        first = first @ whole[i]
        first = first / first.sum()
    for i in range(blocks - 1, -1, -1):
        end[i] = last
        last = whole[i] @ last
        last = last / last.sum()
    before, after, later = (np.empty((blocks, BLOCK, k)) for _ in range(3))
    for j in range(BLOCK):
        before[:, j] = begin
        begin = np.einsum("bi,bij->bj", begin, steps[:, j])
        begin /= begin.sum(1, keepdims=True)
        after[:, j] = begin
    for j in range(BLOCK - 1, -1, -1):
        later[:, j] = end
        end = np.einsum("bij,bj->bi", steps[:, j], end)
        end /= end.sum(1, keepdims=True)
    return tuple(v.reshape(-1, k)[: len(p)] for v in (before, after, later))


def composed(weights: np.ndarray, t: np.ndarray, keys: list[str], scale: Scale) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows of ``chunked`` as (keys, n, step): the number of the chunk, and its steps as one."""

    def steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for v in f["values"]:
                m = np.eye(len(t))
                for one in _products(_steps(_softmax(_standard(v, weights.shape[1] - 1, scale), weights), t)):
                    m = m @ one
                    m = m / m.max()
                out.append(m.ravel())
            yield f[keys].assign(n=f["chunk"] + 1, step=out)

    return steps


def _standard(values: np.ndarray, d: int, scale: Scale) -> np.ndarray:
    x = np.asarray(values, float).reshape(-1, d)
    return x if scale is None else (x - scale[0]) * scale[1]


def expected(weights: np.ndarray, t: np.ndarray, scale: Scale) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A task's sums (i, v) over rows of ``chunked`` with the states at their ends, ``first`` and ``last``: transitions, then scores' slopes, then rows."""
    k, d = weights.shape[0], weights.shape[1] - 1

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moves, slopes, rows = np.zeros((k, k)), np.zeros((k, d + 1)), 0
        for f in frames:
            for n, values, first, last in zip(f["n"], f["values"], f["first"], f["last"], strict=True):
                x = _standard(values, d, scale)
                p = _softmax(x, weights)
                before, after, later = passes(p, t, np.asarray(first, float), np.asarray(last, float))
                gamma = after * later
                gamma /= gamma.sum(1, keepdims=True)
                slopes += (gamma - p).T @ np.hstack([x, np.ones((len(x), 1))])
                xi = before[:, :, None] * t[None] * (p * later)[:, None, :]
                xi /= xi.sum((1, 2), keepdims=True)
                moves += xi[np.asarray(n) > 1].sum(0)
                rows += len(x)
        v = np.concatenate([moves.ravel(), slopes.ravel(), [rows]])
        yield pd.DataFrame({"i": np.arange(len(v)), "v": v})

    return sums


def train(x: DataFrame, keys: list[str], d: int, k: int = len(REGIMES), rounds: int = ROUNDS, rate: float = RATE, seed: int = 42) -> tuple[np.ndarray, np.ndarray, int]:
    """Weights (k rows of d and a constant), transitions and the count of rows, from numbered rows with a ``vector`` of d standard values."""
    return train_chunks(chunked(x, keys), keys, d, k, rounds, rate, seed)


def train_chunks(x: DataFrame, keys: list[str], d: int, k: int = len(REGIMES), rounds: int = ROUNDS, rate: float = RATE, seed: int = 42, scale: Scale = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The same from rows of ``chunked``, whose values are brought to ``scale`` (means, factors) as they are read.

    A round's forward and backward pass give each row's regimes in the light
    of the whole history; transitions are their expected counts with a prior
    that favours staying, and scores go a step towards them. A round reads the
    vectors twice and moves a matrix for each chunk only: chunks are composed,
    those steps are scanned both ways, and chunks are replayed from the states
    at their ends. Without rows the start is returned.
    """
    weights = np.hstack([np.random.default_rng(seed).normal(0, 0.01, (k, d)), np.zeros((k, 1))])
    t, rows = transitions(k), 0
    start = F.array(*[F.lit(1.0 / k)] * k)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.select(*keys).schema)
    last = F.max("n").over(Window.partitionBy(*keys))  # of chunks
    for _ in range(rounds):
        with _few(x.sparkSession):
            steps = stored(x.select(*keys, "chunk", "values").mapInPandas(composed(weights, t, keys, scale), f"{kinds}, n bigint, step array<double>"), "steps")
        ahead = scan(steps, keys, F.col("step"), _then(k), _move(k), start).select(*keys, "n", F.col("before").alias("first"))
        turned = steps.withColumns({"at": F.col("n"), "n": last + 1 - F.col("n"), "step": F.array(*[F.col("step")[j * k + i] for i in range(k) for j in range(k)])})
        behind = scan(turned, keys, F.col("step"), _then(k), _move(k), start).select(*keys, F.col("at").alias("n"), F.col("before").alias("last"))
        ends = ahead.join(behind, [*keys, "n"]).select(*keys, (F.col("n") - 1).alias("chunk"), "first", "last")
        both = x.join(F.broadcast(ends), [*keys, "chunk"]).select("n", "values", "first", "last")
        with _few(x.sparkSession):
            got = both.mapInPandas(expected(weights, t, scale), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        v = np.zeros(k * k + k * (d + 1) + 1)
        for r in got:  # the model's size
            v[r["i"]] = r["v"]
        rows = int(v[-1])
        if not rows:
            break
        counts = v[: k * k].reshape(k, k) + EACH + STICKY * np.eye(k)
        t = counts / counts.sum(1, keepdims=True)
        weights = weights + rate * v[k * k : -1].reshape(k, d + 1) / rows
    return weights, t, rows


def scales(x: DataFrame, d: int) -> Scale:
    """Means and factors that bring each place of rows of ``chunked`` to mean 0 and deviation 1; the factor of a place that doesn't vary is 0."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for values in f["values"]:
                v = np.asarray(values, float).reshape(-1, d)
                mean = v.mean(0)
                yield pd.DataFrame({"pos": np.arange(d), "n": len(v), "mean": mean, "m2": ((v - mean) ** 2).sum(0), "low": v.min(0), "high": v.max(0)})

    with _few(x.sparkSession):
        parts = stored(x.select("values").mapInPandas(sums, "pos int, n bigint, mean double, m2 double, low double, high double"), "places")
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    whole = F.broadcast(parts.groupBy("pos").agg(mean.alias("mid")))  # one row for each place
    square = F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("mid")) ** 2)
    out = np.zeros((2, d))
    for r in parts.join(whole, "pos").groupBy("pos").agg(F.first("mid").alias("mid"), F.sqrt(square / n).alias("sd"), (F.min("low") < F.max("high")).alias("varies")).collect():
        out[:, r["pos"]] = r["mid"], 1 / r["sd"] if r["varies"] and r["sd"] > 1e-12 else 0.0
    return out[0], out[1]


def standard(x: DataFrame, d: int) -> DataFrame:
    """The column ``vector`` with mean 0 and deviation 1 in each place; places that don't vary are 0, as are values that no model can take."""
    m = x.select(F.posexplode(for_model())).groupBy("pos").agg(F.avg("col").alias("mean"), F.stddev_pop("col").alias("sd")).collect()  # one row for each place
    mean, sd = [0.0] * d, [0.0] * d
    for r in m:
        mean[r["pos"]], sd[r["pos"]] = r["mean"], r["sd"]
    scale = [1 / v if v > 1e-12 else 0.0 for v in sd]
    x = x.withColumn("vector", F.zip_with(for_model(), F.array(*[F.lit(v) for v in mean]), lambda a, b: a - b))
    return x.withColumn("vector", F.zip_with("vector", F.array(*[F.lit(v) for v in scale]), lambda a, b: a * b))


K = range(len(REGIMES))


def _forward_sql() -> str:
    t = transitions()
    step = lambda j, a: "(" + " + ".join(f"{float(t[i, j])}::DOUBLE * {a.format(i)}" for i in K) + f") * x.{REGIMES[j]}"
    first = ", ".join(f"{step(j, '0.25::DOUBLE')} AS a{j}" for j in K)
    more = ", ".join(f"{step(j, '(h.a{0} / (h.a0 + h.a1 + h.a2 + h.a3))')}" for j in K)
    return REGIME.replace("WITH base", "WITH RECURSIVE base", 1) + f""", x AS MATERIALIZED (SELECT symbol, seq, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS n, {", ".join(REGIMES)} FROM g),
h AS (SELECT symbol, seq, n, {first} FROM x WHERE n = 1 UNION ALL SELECT x.symbol, x.seq, x.n, {more} FROM h JOIN x ON x.symbol = h.symbol AND x.n = h.n + 1)
SELECT symbol, seq, {", ".join(f"round(a{j} / (a0 + a1 + a2 + a3), 4) AS {REGIMES[j]}" for j in K)} FROM h"""


@query(_forward_sql())
def regime_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regimes of each quote given all quotes up to it: a regime tends to stay, so one odd quote changes little."""
    x = regimes(features(ticks(spark, sf_dir))).select("symbol", "seq", *REGIMES)
    x = forward(numbered(x, ["symbol"]), ["symbol"], REGIMES, transitions())
    return x.select("symbol", "seq", *[F.round(F.col("after")[j], 4).alias(REGIMES[j]) for j in K])


@query()
def train_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the 38 standard features, constant and transitions of each regime, trained on all symbols."""
    quotes = numbered(ticks(spark, sf_dir), ["symbol"]).withColumnRenamed("n", "place")  # numbered while they are narrow
    x = chunked(flatten(loaded(spark, sf_dir, quotes)).select("symbol", F.col("place").alias("n"), for_model().alias("vector")), ["symbol"])
    weights, t, rows = train_chunks(x, ["symbol"], len(VECTOR), scale=scales(x, len(VECTOR)))
    six = lambda v: [round(float(u), 6) + 0.0 for u in v]
    out = [(j, six(weights[j, :-1]), round(float(weights[j, -1]), 6), six(t[j]), rows) for j in K]
    return spark.createDataFrame(out, "regime int, weights array<double>, bias double, transitions array<double>, n bigint")
