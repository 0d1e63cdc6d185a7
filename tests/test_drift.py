"""Slopes, entropies and divergences against plain numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import ordered
from tickloom.functions.ordered import frame_slopes, frame_sums, haloed
from tickloom.operators.drift import BINS, divergence, histograms, metric_slopes, model_metrics, softmax_entropy


def test_slopes_over_chunks_and_nulls(spark):
    rng = np.random.default_rng(3)
    y = [None if rng.random() < 0.2 else float(5 + 0.03 * i + rng.normal()) for i in range(300)]
    x = haloed(spark.createDataFrame([("a", i + 1, v) for i, v in enumerate(y)], "k string, n bigint, y double"), chunk=64, halo=20)
    got = frame_slopes(x, Window.partitionBy("k", "chunk").orderBy("n"), "y", (20,)).where("own").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 301))
    for r in got:
        at = [(i + 1, y[i]) for i in range(max(0, r["n"] - 20), r["n"]) if y[i] is not None]
        if len(at) < 2:
            assert r["y_slope_20"] is None
        else:
            assert r["y_slope_20"] == pytest.approx(np.polyfit(*zip(*at, strict=True), 1)[0], abs=1e-9)


def test_softmax_entropy(spark):
    rows = [(0.0, 0.0, 0.0), (1.0, -1.0, 0.0), (800.0, -800.0, 0.0), (-3.0, 2.0, 2.0)]
    got = spark.createDataFrame(rows, "a double, b double, c double").select("a", softmax_entropy([F.col(c) for c in "abc"]).alias("h")).collect()
    for r, s in zip(got, rows, strict=True):
        p = np.exp(np.array(s) - max(s))
        p /= p.sum()
        assert r["h"] == pytest.approx(-sum(v * math.log(v) for v in p if v > 0), abs=1e-12)


def test_divergence_from_the_reference(spark):
    rng = np.random.default_rng(5)
    rows = [("s", t, float(v)) for t, (m, n) in enumerate([(0, 500), (0, 400), (4, 300)]) for v in rng.normal(m, 1, n)] + [("s", 1, None)]
    x = spark.createDataFrame(rows, "k string, t int, v double").repartition(5)
    first = spark.createDataFrame([("s", 0)], "k string, t int")
    got = {r["t"]: r for r in divergence(histograms(x, ["k"], "t", "v", first), ["k"], "t", first).collect()}
    by = {t: np.array([v for _, u, v in rows if u == t and v is not None]) for t in range(3)}
    mid, sd = by[0].mean(), by[0].std()
    shares = {t: np.bincount(np.clip(np.floor((v - mid) / sd * 2) + BINS // 2, 0, BINS - 1).astype(int), minlength=BINS) / len(v) for t, v in by.items()}
    for t, p in shares.items():
        both = (p > 0) & (shares[0] > 0)
        assert got[t]["rows"] == len(by[t])
        assert got[t]["kl"] == pytest.approx(float((p[both] * np.log(p[both] / shares[0][both])).sum()), abs=1e-9)
        assert got[t]["l2"] == pytest.approx(float(np.linalg.norm(p - shares[0])), abs=1e-9)
    assert got[0]["kl"] == 0 and got[2]["kl"] > 1 > got[1]["kl"]


def test_one_value_and_none(spark):
    x = spark.createDataFrame([("s", 0, 2.0), ("s", 1, 2.0)], "k string, t int, v double")
    first = x.where("t = 0").select("k", "t")
    assert [(r["t"], r["kl"], r["l2"]) for r in divergence(histograms(x, ["k"], "t", "v", first), ["k"], "t", first).orderBy("t").collect()] == [(0, 0.0, 0.0), (1, 0.0, 0.0)]
    none = x.where("t > 5")
    assert divergence(histograms(none, ["k"], "t", "v", first), ["k"], "t", first).count() == 0


def test_metrics_and_trends_share_a_few_windows_that_hold_plain_rows(spark):
    d = spark.createDataFrame([("A", i, "Buy", 100000, i % 11 / 1e4, i % 20 / 10, i % 100, i % 7 / 10) for i in range(50)], "strategy string, seq bigint, direction string, lots bigint, slippage double, latency_ms double, k bigint, q_sampled double")
    for f in (metric_slopes, model_metrics):
        plan = f(d)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Window [") <= 12  # a final and an initial plan may both be shown; each trend had ten of its own
    assert ordered.CHUNK + ordered.HALO <= ordered.HELD <= int(spark.conf.get("spark.sql.windowExec.buffer.in.memory.threshold"))


def test_columns_together_equal_columns_alone(spark):
    rng = np.random.default_rng(8)
    x = haloed(spark.createDataFrame([("a", i + 1, float(rng.normal(9, 2)), None if i % 7 == 0 else float(i % 5)) for i in range(200)], "k string, n bigint, y double, z double"), chunk=64, halo=20)
    w = Window.partitionBy("k", "chunk").orderBy("n")
    for f in (frame_sums, frame_slopes):
        both, alone = f(x, w, ("y", "z"), (10, 20)), f(f(x, w, "y", (10, 20)), w, "z", (10, 20))
        assert sorted(map(str, both.select(*alone.columns).collect())) == sorted(map(str, alone.collect()))
