"""Passes and training of the sticky model, and change points, against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators.adaptive import changes
from tickloom.operators.sticky import EACH, RATE, STICKY, backward, chunked, forward, scales, standard, train, train_chunks, transitions

NAMES = ["p0", "p1", "p2"]


def passes(p, t):
    """Filtered probabilities before and after each row, and how likely the later rows are."""
    k, n = t.shape[0], len(p)
    a, before, after = np.full(k, 1 / k), [], []
    for row in p:
        before.append(a)
        a = a @ t * row
        a = a / a.sum()
        after.append(a)
    b, later = np.full(k, 1 / k), [None] * n
    for i in range(n - 1, -1, -1):
        later[i] = b
        b = t @ (p[i] * b)
        b = b / b.sum()
    return np.array(before), np.array(after), np.array(later)


def test_both_passes_over_chunks(spark):
    rng = np.random.default_rng(11)
    p = {s: rng.dirichlet(np.ones(3) * 0.2, n) for s, n in (("a", 700), ("b", 1), ("c", 129))}
    df = spark.createDataFrame([(s, i + 1, *map(float, r)) for s, v in p.items() for i, r in enumerate(v)], "s string, n bigint, p0 double, p1 double, p2 double").repartition(5)
    t = transitions(3, 0.8)
    ahead = {(r["s"], r["n"]): (r["before"], r["after"]) for r in forward(df, ["s"], NAMES, t).collect()}
    behind = {(r["s"], r["n"]): r["later"] for r in backward(df, ["s"], NAMES, t).collect()}
    assert len(ahead) == len(behind) == 830
    for s, v in p.items():
        before, after, later = passes(v, t)
        for i in range(len(v)):
            assert np.allclose(ahead[s, i + 1][0], before[i], atol=1e-10) and np.allclose(ahead[s, i + 1][1], after[i], atol=1e-10)
            assert np.allclose(behind[s, i + 1], later[i], atol=1e-10)


def test_rows_that_say_nothing_and_extreme_ones(spark):
    rows = [("a", 1, 0.0, 1e-300, 0.0), ("a", 2, None, 0.5, 0.5), ("a", 3, 0.0, 0.0, 0.0), ("a", 4, float("nan"), 1.0, 1.0), ("a", 5, 1e300, 0.0, 0.0)]
    t = transitions(3, 0.7)
    got = forward(spark.createDataFrame(rows, "s string, n bigint, p0 double, p1 double, p2 double"), ["s"], NAMES, t).orderBy("n").collect()
    want = passes(np.array([[0, 1, 0], [1, 1, 1], [1, 1, 1], [1, 1, 1], [1, 0, 0]], float), t)[1]
    assert np.allclose([r["after"] for r in got], want, atol=1e-12)
    assert forward(spark.createDataFrame([], "s string, n bigint, p0 double, p1 double, p2 double"), ["s"], NAMES, t).count() == 0


def test_training_equals_plain_rounds(spark):
    rng = np.random.default_rng(2)
    x = {s: rng.normal(size=(n, 4)) for s, n in (("a", 150), ("b", 40))}
    df = spark.createDataFrame([(s, i + 1, r.tolist()) for s, v in x.items() for i, r in enumerate(v)], "s string, n bigint, vector array<double>").repartition(3)
    w, t, rows = train(df, ["s"], 4, k=3, rounds=2)
    plain, pt = np.hstack([np.random.default_rng(42).normal(0, 0.01, (3, 4)), np.zeros((3, 1))]), transitions(3)
    for _ in range(2):
        slopes, moves = np.zeros((3, 5)), np.zeros((3, 3))
        for v in x.values():
            one = np.hstack([v, np.ones((len(v), 1))])
            p = np.exp(one @ plain.T)
            p /= p.sum(1, keepdims=True)
            before, after, later = passes(p, pt)
            gamma = after * later
            gamma /= gamma.sum(1, keepdims=True)
            slopes += (gamma - p).T @ one
            for i in range(1, len(v)):
                xi = before[i][:, None] * pt * (p[i] * later[i])[None]
                moves += xi / xi.sum()
        pt = moves + EACH + STICKY * np.eye(3)
        pt /= pt.sum(1, keepdims=True)
        plain = plain + RATE * slopes / 190
    assert rows == 190
    assert np.allclose(w, plain, atol=1e-10) and np.allclose(t, pt, atol=1e-10)


def test_training_over_small_chunks_moves_no_vectors(spark, monkeypatch):
    from tickloom.operators import sticky

    rng = np.random.default_rng(3)
    x = {s: rng.normal(2, 3, size=(n, 3)) * [1, 5, 0] for s, n in (("a", 201), ("b", 40), ("c", 1))}
    df = spark.createDataFrame([(s, i + 1, r.tolist()) for s, v in x.items() for i, r in enumerate(v)], "s string, n bigint, vector array<double>").repartition(3)
    small = chunked(df, ["s"], 40)
    assert small.count() == 6 + 1 + 1
    scale = scales(small, 3)
    every = np.concatenate(list(x.values()))
    assert np.allclose(scale[0], every.mean(0)) and np.allclose(scale[1], [1 / every[:, 0].std(), 1 / every[:, 1].std(), 0])
    want = train(standard(df, 3), ["s"], 3, k=4, rounds=2)
    kept = []
    monkeypatch.setattr(sticky, "scan", lambda x, *more: kept.append(x.columns) or sticky.__dict__["_scan"](x, *more), raising=True)
    monkeypatch.setattr(sticky, "_scan", __import__("tickloom.functions.ordered", fromlist=["scan"]).scan, raising=False)
    got = train_chunks(small, ["s"], 3, k=4, rounds=2, scale=scale)
    assert got[2] == want[2] == 242 and np.allclose(got[0], want[0], atol=1e-10) and np.allclose(got[1], want[1], atol=1e-10)
    assert len(kept) == 4 and not any(c in ("vector", "values") for cols in kept for c in cols)


def test_standard_places(spark):
    rows = [(1, [1.0, 5.0, None]), (2, [3.0, 5.0, float("nan")]), (3, [None, 5.0, float("inf")])]
    got = [r["vector"] for r in standard(spark.createDataFrame(rows, "n bigint, vector array<double>"), 3).orderBy("n").collect()]
    first = np.array([1.0, 3.0, 0.0])
    assert np.allclose(np.array(got)[:, 0], (first - first.mean()) / first.std()) and np.allclose(np.array(got)[:, 1:], 0)


def plain_changes(x, least, most, grace, delta):
    window, out, free = [], [], 0
    for i, v in enumerate(x):
        if i + 1 < least:
            continue
        window = [*window, v][-most:]
        n = len(window)
        if i < free or n < 2 * least:
            continue
        best = max(abs(np.mean(window[:k]) - np.mean(window[k:])) / np.sqrt(np.log(4 * (n - 2 * least + 1) / delta) / (2 * min(k, n - k))) for k in range(least, n - least + 1))
        if best > 1:
            out.append((i, best))
            free = i + grace
    return out


@pytest.mark.parametrize(("most", "grace", "chunk"), [(60, 15, 64), (40, 50, 40), (200, 7, 1000)])
def test_change_points_equal_a_plain_window(spark, most, grace, chunk):
    rng = np.random.default_rng(4)
    x = {"a": np.concatenate([rng.normal(0, 0.3, 150), rng.normal(4, 0.3, 120), rng.normal(1, 2, 130)]), "b": np.full(90, 2.0), "c": rng.normal(size=12)}
    df = spark.createDataFrame([(s, i * 3, float(v), "x") for s, r in x.items() for i, v in enumerate(r)], "s string, seq bigint, x double, n string").repartition(6)
    got = sorted((r["s"], r["seq"] // 3, round(r["score"], 9)) for r in changes(df, ["s"], 10, most, grace, 0.05, chunk).collect())
    want = [(s, i, round(v, 9)) for s, r in x.items() for i, v in plain_changes(r, 10, most, grace, 0.05)]
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(got) > 3
    assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_change_points_of_odd_values(spark):
    rows = [("a", i, None if i % 3 == 0 else float("nan") if i % 3 == 1 else float(i > 300) * 5) for i in range(600)]
    df = spark.createDataFrame(rows, "s string, seq bigint, x double")
    want = plain_changes([v for _, _, v in rows if v is not None and v == v], 10, 50, 20, 0.05)
    assert sorted(r["seq"] for r in changes(df, ["s"], 10, 50, 20, 0.05, 64).collect()) == [3 * i + 2 for i, _ in want]
    assert changes(df.where(F.lit(False)), ["s"]).count() == 0
    with pytest.raises(ValueError, match="chunk"):
        changes(df, ["s"], most=100, chunk=50)
