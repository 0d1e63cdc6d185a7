"""Composed scans, exponential means, keyed as-of states, average cost and lives against plain folds."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions.ordered import asof, ema, numbered, scan
from tickloom.functions.sequential import project_rows
from tickloom.operators.positions import average_cost, lives, valued


def test_scan_composes_maps_of_states(spark):
    """An automaton of three states, by maps of states, over several levels of chunks."""
    rng = random.Random(1)
    table = [[1, 1, 2], [0, 2, 2], [0, 1, 0]]
    rows = [(k, i, rng.randrange(3)) for k in "ab" for i in range(1, 70 if k == "a" else 9)]
    want = {}
    for k in "ab":
        s = 0
        for key, i, x in rows:
            if key == k:
                want[k, i] = (s, table[x][s])
                s = table[x][s]
    df = numbered(spark.createDataFrame(rows, "key string, seq long, x int").repartition(3), ["key"])
    maps = F.element_at(F.array(*[F.array(*map(F.lit, t)) for t in table]), F.col("x") + 1)
    out = scan(df, ["key"], maps, lambda f, g: F.transform(f, lambda s: F.get(g, s)), lambda s, f: F.get(f, s), F.lit(0), fan=4)
    assert {(r["key"], r["seq"]): (r["before"], r["after"]) for r in out.collect()} == want


def test_scan_of_nothing(spark):
    df = spark.createDataFrame([], "key string, seq long, x int, n long")
    assert scan(df, ["key"], F.col("x"), lambda f, g: f + g, lambda s, f: s + f, F.lit(0)).collect() == []


@pytest.mark.parametrize("alpha", [0.001, 0.1, 0.97])
def test_exponential_mean(spark, alpha):
    rng = random.Random(2)
    values = [rng.random() for _ in range(4000)]
    df = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate(values)], "key string, n long, x double")
    e, want = 0.5, []
    for v in values:
        e += alpha * (v - e)
        want.append(e)
    got = [r["e"] for r in ema(df, ["key"], {"e": ("x", 0.5)}, alpha).orderBy("n").collect()]
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-9
    short = [r["e"] for r in ema(df, ["key"], {"e": ("x", 0.5)}, alpha, block=100).orderBy("n").collect()]
    assert max(abs(a - b) for a, b in zip(short, want, strict=True)) < 1e-9
    with pytest.raises(ValueError):
        ema(df, ["key"], {"e": ("x", 0.5)}, 1.0)


def test_asof_by_key(spark):
    left = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([(5, "a"), (10, "a"), (10, "b"), (250, "a"), (3, "c")])], "seq long, ts_ns long, key string")
    right = spark.createDataFrame([("a", 5, 1, 1.0), ("a", 9, 2, 2.0), ("b", 11, 3, 3.0), ("a", 9, 4, 4.0), ("b", 1, 5, None)], "key string, ts_ns long, seq long, v double")
    for stretch in (1000, 100, 4):
        assert {r["seq"]: r["v"] for r in asof(left, right, ["v"], stretch=stretch, by=["key"]).collect()} == {0: 1.0, 1: 4.0, 2: None, 3: 4.0, 4: None}


def test_average_cost_equals_the_fold(spark):
    import pandas as pd

    rng = random.Random(3)
    rows = [(k, i, i * 10, rng.choice([-3.0, -2.0, -1.0, 0.0, 1.0, 2.0]), round(100 + rng.random(), 4)) for k in "AB" for i in range(700)]
    f = pd.DataFrame(rows, columns=["strategy", "seq", "ts_ns", "size", "price"])
    want = {(r.strategy, r.seq): r for r in next(project_rows(iter([f[f["size"] != 0]]))).itertuples()}
    df = numbered(spark.createDataFrame(rows, "strategy string, seq long, ts_ns long, size double, price double"), ["strategy"])
    for r in average_cost(df, ["strategy"]).collect():
        if r["size"] != 0:
            w = want[r["strategy"], r["seq"]]
            assert r["position"] == w.position and math.isclose(r["entry"], w.entry, abs_tol=1e-9) and math.isclose(r["realized"], w.realized, abs_tol=1e-9)


def test_value_of_a_flat_strategy_is_zero(spark):
    quotes = spark.createDataFrame([("X", 1, 10, 1.0, 3.0)], "symbol string, seq long, ts_ns long, bid double, ask double")
    states = spark.createDataFrame([("A", 1, 5, 2.0, 1.5, 7.0), ("B", 2, 11, 1.0, 1.0, 1.0)], "strategy string, seq long, ts_ns long, position double, entry double, realized double")
    got = {r["strategy"]: (r["position"], r["realized"], r["unrealized"]) for r in valued(quotes, states).collect()}
    assert got == {"A": (2.0, 7.0, 1.0), "B": (0.0, 0.0, 0.0), "C": (0.0, 0.0, 0.0)}


def plain_lives(rows, threshold, episodes, window, row, strict, share):
    out, returns, alive, week0, regime0 = [], [], False, None, None
    life = pos = n = run = loss = born = 0
    for _, seq, pnl, week, regime, unknown, day, size in rows:
        pos += size
        if week != week0 and not alive:
            alive, life, n, run, loss, born, returns = True, life + 1, 0, 0, 0, seq, []
            out.append([life, born, None, None, None, None, None])
        if regime != regime0:
            loss = 0
        week0, regime0 = week, regime
        if not alive:
            continue
        n, loss = n + 1, loss + pnl
        returns = [*returns, pnl][-window:]
        reason = None
        if n >= episodes:
            mean = sum(returns) / len(returns)
            dev = math.sqrt(sum((x - mean) ** 2 for x in returns) / (len(returns) - 1))
            run = run + 1 if mean / max(dev, 1e-10) < threshold * (strict if unknown else 1) else 0
            reason = "low_sharpe" if run >= row else "regime_loss" if day and loss < -abs(day) * share else None
        if reason:
            alive = False
            out[-1][2:] = [seq, n, reason, "Sell" if pos > 0 else "Buy" if pos < 0 else None, abs(pos) or None]
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", range(4))
def test_lives_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    rows, day = [], 0
    for i in range(1500):
        if i % 40 == 0:
            day = 0
        pnl = rng.randrange(-100, 101) - (25 if i // 200 % 2 else 0)
        day += pnl
        rows.append((i * 1000, i, pnl, i // (37 if seed % 2 else 150), i // (400 if seed < 2 else 60) % 3, i // 90 % 4 == 0, day, rng.choice([-2, -1, 1, 2])))
    t = spark.createDataFrame([("A", *r) for r in rows], "strategy string, ts_ns long, seq long, pnl_c long, week long, regime long, unknown boolean, day_pnl_c long, size long")
    args = dict(threshold=-0.1, episodes=20, window=15, row=3, strict=1.5, share=(0.5, 40.0, 3.0, 12.0)[seed])
    got = sorted(tuple(r)[1:] for r in lives(t, yearly=1.0, **args).collect())
    want = plain_lives(rows, **args)
    assert [(x[0], x[1], x[2], x[3], x[4], x[5], x[6]) for x in got] == want and len(want) > 2
