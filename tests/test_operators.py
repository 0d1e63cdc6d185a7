"""Hand-made cases: quote files, time stamps, empty and flat series, precedence of limits, kernels."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.sequential import Regression, Windowed, project_rows
from tickloom.operators import risk, stats, validation
from tickloom.sources import quotes

T0 = 1_700_000_000_000_000_000
TRADE = "ts_ns bigint, seq bigint, strategy string, pnl_c bigint, slippage double, fill_probability double, latency_ms double, close_reason string"


def trades(spark, profits, gap=10**9, reason=None):
    return spark.createDataFrame([(T0 + i * gap, i, "A", p, 0.0001, 0.9, 1.0, reason) for i, p in enumerate(profits)], TRADE)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1700000000000000000", T0), ("1700000000", T0), ("2023-11-14T22:13:20", T0), ("2023-11-14 22:13:20", T0), ("2023-11-14T22:13:20.500", T0 + 500_000_000),
        ("15.11.2023 07:13:20.000 GMT+0900", T0), ("2023.11.15 00:13:20.000", T0), ("1700000000000", None), ("yesterday", None), ("", None), (None, None),
    ],
)
def test_time_stamps(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(quotes.timestamp_ns(F.col("s"))).first()[0] == want


def test_quote_file(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text("Local Time,Bid,Ask,Pair\n1700000000,110.001,110.003,EUR/USD\n1700000001,110.005,110.003,EUR/USD\n1700000000,110.0,110.1,EUR/USD\n1700000002,110.0,110.1,EUR/USD\n")
    raw = quotes.read_csv(spark, str(p))
    assert [r["problem"] for r in quotes.checked(raw).orderBy("row").collect()] == [None, "crossed", "order", None]
    assert quotes.lenient(raw).count() == 2
    with pytest.raises(ValueError, match="row 3: crossed"):
        quotes.strict(raw)
    first = quotes.lenient(raw).orderBy("row").first()
    assert (first["ts_ns"], first["bid_size"], first["symbol"]) == (T0, 0.0, "EUR/USD")


def test_summary_of_nothing_and_of_one(spark):
    assert stats.summary(trades(spark, [])).collect() == []
    one = stats.summary(trades(spark, [500])).first()
    assert (one["n"], one["n_win"], one["profit_factor"], one["avg_interval_ns"]) == (1, 1, float("inf"), 0)
    assert stats.summary(trades(spark, [-5, -5])).first()["profit_factor"] == 0.0


def test_streaks_end_at_zero(spark):
    r = stats.longest_runs(trades(spark, [1, 1, 0, 1, -1, -1, -1, 0, -1])).first()
    assert (r["win_streak"], r["loss_streak"]) == (2, 3)


def test_drawdown_without_recovery(spark):
    t = trades(spark, [100, -50, -20, 10])
    assert stats.equity(t).agg(F.max("drawdown_c")).first()[0] == 70
    assert stats.drawdown_length(t).first()[1] == 3 * 10**9
    assert stats.drawdown_length(trades(spark, [100, -50, 60])).first()[1] == 2 * 10**9


def test_ratios_count_closing_trades(spark):
    t = trades(spark, [1, 2]).union(trades(spark, [3], reason="MAX_HOLD_TIME"))
    assert stats.closing(t).count() == 1
    assert stats.closing(trades(spark, [1, 2])).count() == 2


def test_month_goes_before_week_and_day(spark):
    df = spark.createDataFrame([(-600_000, -300_000, -200_000), (0, -300_000, -200_000), (0, 0, -200_000), (0, 0, -100_000)], "month_pnl_c long, week_pnl_c long, day_pnl_c long")
    assert [r[0] for r in df.select(risk.limit_reason()).collect()] == ["monthly_halt", "weekly_halt", "daily_realized_halt", None]


@pytest.mark.parametrize(("ms", "status", "lot"), [(0, "Normal", 100000), (999, "Normal", 96007), (1000, "Warning", 96000), (2000, "Degraded", 84000), (4999, "Degraded", 0), (5000, "Halted", 0)])
def test_staleness(spark, ms, status, lot):
    b = risk.barrier(F.col("ms"))
    r = spark.createDataFrame([(ms,)], "ms long").select(b["status"].alias("s"), b["lot"].alias("l")).first()
    assert (r["s"], r["l"]) == (status, lot)


def test_splits_cover_and_do_not_overlap(spark):
    r = spark.createDataFrame([("A", i, float(i % 7)) for i in range(1, 121)], "strategy string, obs long, ret double")
    s = validation.splits(r).groupBy("split").pivot("role", ["test", "train", "purged"]).count().collect()
    assert len(s) == 15
    assert all(x["test"] + (x["train"] or 0) + (x["purged"] or 0) == 120 and x["test"] == 40 for x in s)


def test_regression_finds_the_weights():
    rng, m = np.random.default_rng(1), Regression(3, ridge=0.01)
    w = np.array([1.0, -2.0, 0.5])
    for _ in range(400):
        x = rng.standard_normal(3)
        m.update(x, float(w @ x))
    assert np.abs(m.w - w).max() < 1e-3
    assert m.variance(np.ones(3)) >= 0
    assert (m.sample(np.random.default_rng(5)) == m.sample(np.random.default_rng(5))).all()


def test_change_point():
    c = Windowed()
    assert max(c.push(0.0) for _ in range(200)) <= 1
    assert max(c.push(3.0) for _ in range(200)) > 1


def test_average_cost():
    import pandas as pd

    f = pd.DataFrame({"strategy": ["A"] * 4, "seq": range(4), "size": [1.0, 1.0, -1.0, -2.0], "price": [10.0, 12.0, 13.0, 14.0]})
    out = next(project_rows(iter([f])))
    assert out["entry"].tolist() == [10, 11, 11, 11]
    assert out["realized"].tolist() == [0, 0, 2, 5]
    assert out["position"].tolist() == [1, 2, 1, -1]


def quote(spread=0.01, rv=0.001, obi=0.3):
    return np.array([spread, 1.0, obi, 0.0, 0.0, rv, 1.0, 0.0, 0.0, 1000.0, 1000.0, spread, 0.5, 0.5])


def test_features_of_a_run_have_their_places():
    from tickloom.functions.sequential import DIM, Run
    from tickloom.operators.vector import VECTOR

    for s in "ABC":
        run = Run(s, 1)
        x = run.features(10**15, 100.0, quote())
        assert len(x) == DIM == len(VECTOR) + 5
        at = dict(zip(VECTOR, x, strict=False))
        assert (at["spread"], at["obi"], at["position_size"], at["time_decay"], at["session_tokyo"]) == (0.01, 0.3, 0.0, 1.0, 1.0)
        run.side, run.entry, run.since = -1.0, 101.0, 10**15 - 5_000_000
        at = dict(zip(VECTOR, run.features(10**15, 100.0, quote()), strict=False))
        assert at["position_direction"] == -1 and at["pnl_unrealized"] == 1.0 and abs(at["time_decay"] - np.exp(-0.05)) < 1e-12


def test_a_position_ends_by_time_or_loss_and_halts_the_day():
    from tickloom.functions.sequential import Run

    run = Run("A", 1, daily_loss=1.0)
    t = 10**15

    def hold(ts):
        run.side, run.entry, run.since, run.x, run.action = 1.0, 100.0, ts, run.features(ts, 100.0, quote()), "Buy"

    hold(t)
    run.step(t + 29_000_000_000, 100.0, False, quote(), True)
    assert run.side == 1.0
    run.step(t + 30_000_000_000, 100.0, False, quote(), True)
    assert run.side == 0.0 and run.out["n_trades"] == 1 and run.out["forced"] == 0
    hold(t + 31_000_000_000)
    run.step(t + 32_000_000_000, 98.0, True, quote(), True)
    assert run.side == 0.0 and run.out["forced"] == 1 and run.halted
    run.step(t + 33_000_000_000, 98.0, True, quote(), True)
    assert run.side == 0.0 and run.policy.traded == []
    run.step(t + 86_400_000_000_000, 98.0, False, quote(), True)
    assert not run.halted


def test_modes_learn_where_they_should():
    from tickloom.functions.sequential import Run

    for mode, before, after in (("cold", 0, 1), ("warm", 1, 2), ("frozen", 1, 1)):
        run, t = Run("C", 1, mode), 10**15
        for i, test in enumerate((False, True)):
            if not (mode == "cold" and not test):
                run.side, run.entry, run.since, run.x, run.action = 1.0, 100.0, t, run.features(t, 100.0, quote()), "Buy"
            run.step(t + 600_000_000_000, 101.0, False, quote(), test)
            assert run.policy.models["Buy"].n == (before, after)[i], mode
        assert run.out["n_trades"] == 1


def test_a_policy_that_never_trades_widens_its_posterior():
    from tickloom.functions.sequential import Policy

    p = Policy(np.random.default_rng(1))
    for _ in range(99):
        p.record(False)
    assert p.inflation == 1.0
    p.record(False)
    assert p.inflation == 1.5 and p.models["Hold"].inverse[0, 0] == 1.5
    for _ in range(30):
        p.record(True)
    assert 1.0 < p.inflation < 1.5


def test_rows_of_a_split_file_are_numbered_in_order(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text("timestamp,bid,ask\n" + "".join(f"{1_700_000_000 + i},{100 + i}.0,{101 + i}.0\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        raw = quotes.read_csv(spark, str(p))
        got = raw.select("row", F.col("bid").cast("double").alias("b")).collect()
        assert sorted(int(r["row"]) for r in got) == list(range(2, 3002)) and all(r["b"] == 98 + r["row"] for r in got)
        assert quotes.lenient(raw).count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def folds_input(spark):
    rng = random.Random(6)
    rows = [(s, 3 * i + (i > 40), None if i % 19 == 0 else rng.gauss(0.1, 1) if s != "c" else 0.5) for s, n in (("a", 130), ("b", 97), ("c", 60)) for i in range(n)]
    return spark.createDataFrame(rows, "strategy string, obs bigint, ret double").repartition(4)


def test_sums_by_split_equal_sums_over_copies(spark):
    r = folds_input(spark)
    got = validation.split_sums(r).groupBy("strategy", "split", "role").agg(F.sum("n").alias("n"), F.sum("sum_obs").alias("s"))
    want = validation.splits(r).groupBy("strategy", "split", "role").agg(F.count("*").alias("n"), F.sum("obs").alias("s"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert validation.zones(r).count() == 287  # no observation is copied


def test_scores_by_sums_equal_scores_over_copies(spark):
    r, sd = folds_input(spark), F.stddev_samp("ret")
    want = validation.splits(r).where("role <> 'purged'").groupBy("strategy", "split", "role").agg(F.when(sd > 1e-12, F.avg("ret") / sd).otherwise(0.0).alias("sharpe"))
    got = {x[:3]: x[3] for x in map(tuple, validation.scores(r).collect())}
    want = {x[:3]: x[3] for x in map(tuple, want.collect())}
    assert got.keys() == want.keys() and len(got) == 90
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want) and all(v == 0 for k, v in got.items() if k[0] == "c")


def test_no_join_deals_observations_out_by_strategy(spark):
    r = folds_input(spark).withColumn("n", F.col("obs"))
    for x in (validation.splits(r), validation.scores(r), validation.degraded(r), validation.deflated(r)):
        assert "SortMergeJoin" not in x._jdf.queryExecution().executedPlan().toString()
