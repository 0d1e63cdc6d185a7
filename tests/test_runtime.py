"""Schemas, settings, files, the command line, and ordered operators against plain Python."""

from __future__ import annotations

import json
import math
import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom import __main__ as cli
from tickloom import config
from tickloom.functions import ordered
from tickloom.operators import runtime, validation, vector
from tickloom.sources import results

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_registry_keeps_what_it_has(spark):
    r = runtime.SchemaRegistry()
    r.register("trade", 2)
    r.register("trade", 1)
    assert r.versions("trade") == [1, 2] and r.latest("trade") == 2 and r.latest("order") is None
    with pytest.raises(ValueError, match="already"):
        r.register("trade", 1)
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "version int, x double")
    with pytest.raises(ValueError, match="no upcaster"):
        r.upcast(old, "trade")
    with pytest.raises(ValueError, match="no schema"):
        r.upcast(old, "order")
    r.upcaster("trade", 1, lambda d: d.withColumns({"x": F.col("x") * 10, "y": F.lit("new")}))
    assert sorted(map(tuple, r.upcast(old, "trade").select("version", "x", "y").collect())) == [(2, 2.0, None), (2, 10.0, "new")]


@pytest.mark.parametrize("text", ["", "A,,B", "D", "a,x"])
def test_unknown_strategies(text):
    with pytest.raises(ValueError, match="unknown strategy"):
        runtime.parse_strategies(text)


def test_settings():
    c = config.parse('seed = 7\nstrategies = ["a", "C"]\n[risk]\nmax_weekly_loss = 100\n[strategy_b]\nobi = 0.3')
    assert (c.seed, c.strategies, c.risk.limits()["max_weekly_loss"], c.strategy_b.obi, c.strategy_b.max_hold_ms) == (7, ("A", "C"), -100.0, 0.3, 300_000)
    for bad in ("nothing = 1", "risk = 3", "seed = 'x'", "[risk]\nmax_weekly_loss = -1", "[alerts]\nrisk_limit_threshold = 1.5", "strategies = 'Z'"):
        with pytest.raises(ValueError):
            config.parse(bad)


def test_quiet_time_between_alerts():
    import pandas as pd

    rows = pd.DataFrame({"strategy": list("AAAAAB"), "type": ["x"] * 3 + ["y"] * 2 + ["x"], "ts_ns": [0, 5, 10, 11, 20, 12]})
    assert pd.concat(runtime.quiet(10)(iter([rows[:2], rows[2:]])))["ts_ns"].tolist() == [0, 10, 11, 12]


def rows_of(rng, n):
    return [(k, i, i * 7 + rng.randrange(5), rng.choice([None, rng.random()])) for k in "ab" for i in sorted(rng.sample(range(n * 5), n))]


def test_ordered_operators_in_small_chunks(spark):
    rng = random.Random(1)
    data = rows_of(rng, 120)
    df = spark.createDataFrame(data, "k string, seq long, ts_ns long, x double").repartition(5)
    n = ordered.numbered(df, ["k"], bucket=50)
    by = {k: [r for r in data if r[0] == k] for k in "ab"}
    got = {(r["k"], r["seq"]): r for r in ordered.carried_last(ordered.running(n, ["k"], {"s": F.coalesce("x", F.lit(0.0))}, chunk=16), ["k"], "x", "last", chunk=16).collect()}
    means = {(r["k"], r["seq"]): r["e"] for r in ordered.ema(n.withColumn("v", F.coalesce("x", F.lit(0.0))), ["k"], {"e": ("v", 0.5)}, 0.3, block=32).collect()}
    h = ordered.frame_sums(ordered.haloed(n, chunk=32, halo=20), Window.partitionBy("k", "chunk").orderBy("n"), "x", (10,)).where("own")
    frames = {(r["k"], r["seq"]): r for r in h.collect()}
    for k, own in by.items():
        total, last, e = 0.0, None, 0.5
        for i, (_, seq, _, x) in enumerate(own):
            total, last, e = total + (x or 0.0), x if x is not None else last, e + 0.3 * ((x or 0.0) - e)
            r = got[k, seq]
            assert (r["n"], r["last"]) == (i + 1, last) and abs(r["s"] - total) < 1e-9 and abs(means[k, seq] - e) < 1e-6
            part = [y for *_, y in own[max(0, i - 9) : i + 1] if y is not None]
            f = frames[k, seq]
            assert f["x_count_10"] == len(part)
            if part:
                mean = sum(part) / len(part)
                assert abs(f["x_mean_10"] - mean) < 1e-9 and abs(f["x_m2_10"] - sum((y - mean) ** 2 for y in part)) < 1e-9


def test_asof_and_recent(spark):
    rng = random.Random(2)
    left = [(i, rng.randrange(1000)) for i in range(80)]
    right = [(i, rng.randrange(1000), float(i)) for i in range(60)]
    a, b = spark.createDataFrame(left, "id long, ts_ns long"), spark.createDataFrame(right, "seq long, ts_ns long, v double")
    at = {r["id"]: r["v"] for r in ordered.asof(a, b, ["v"], stretch=70).collect()}
    near = {r["id"]: r["s"] for r in ordered.recent(a, b, {"s": F.col("v")}, 50).collect()}
    for i, t in left:
        before = [(u, s, v) for s, u, v in right if u <= t]
        assert at[i] == (max(before)[2] if before else None)
        assert near[i] == sum(v for _, u, v in right if t - 50 <= u <= t)


def test_vector_form(spark):
    assert len(vector.VECTOR) == 38 == len(set(vector.VECTOR))
    inf = float("inf")
    v = [1.0] * 38
    v[0], v[13], v[14], v[15] = float("nan"), -5.0, inf, inf
    x = spark.createDataFrame([(v,), ([1.0, 2.0],), ([],)], "vector array<double>")
    got = x.select(vector.for_model().alias("m")).collect()[0]["m"]
    assert (got[0], got[13], got[14], got[15], got[20]) == (0.0, 0.0, 86_400_000.0, 0.0, 1.0)
    back = vector.unflatten(x).collect()
    assert back[0]["entry_price"] == 1.0 and back[1]["spread"] is None and back[2]["spread"] is None
    again = vector.flatten(vector.unflatten(x.limit(1)).fillna(0.0), at="again").collect()[0]
    assert len(again["again"]) == 38


def test_feature_dump_is_checked(spark, tmp_path):
    x = spark.createDataFrame([(i, *[float(i + j) for j in range(38)]) for i in range(4)], "ts_ns long, " + ", ".join(f"{n} double" for n in vector.VECTOR))
    results.dump_features(x, str(tmp_path / "f"))
    assert results.read_features(spark, str(tmp_path / "f")).count() == 4
    with pytest.raises(ValueError, match="versions"):
        results.read_features(spark, str(tmp_path / "f"), version="other")
    x.select("ts_ns").write.csv(str(tmp_path / "g"), header=True)
    with pytest.raises(ValueError, match="columns"):
        results.read_features(spark, str(tmp_path / "g"))
    scales = results.fit_scales(results.read_features(spark, str(tmp_path / "f")))
    assert all(r["scale"] >= 1 for r in scales.collect())
    with pytest.raises(ValueError, match="version"):
        results.apply_scales(x, scales.withColumn("feature_version", F.lit("other")))


def test_dump_and_scales_are_compiled(spark, tmp_path):
    inf, rng = float("inf"), random.Random(3)
    rows = [(i, *[rng.choice([rng.uniform(-9, 9), rng.uniform(-1e9, 1e9), 0.0, float("nan"), inf, -inf, None]) for _ in range(38)]) for i in range(50)]
    x = spark.createDataFrame(rows, "ts_ns long, " + ", ".join(f"{n} double" for n in vector.VECTOR))
    results.dump_features(x, str(tmp_path / "f"))
    dump = results.read_features(spark, str(tmp_path / "f"))
    want = {r["ts_ns"]: r["m"] for r in vector.flatten(x).select("ts_ns", vector.for_model().alias("m")).collect()}
    assert {r[0]: list(r[3:]) for r in dump.collect()} == want
    some = dump.withColumns({vector.VECTOR[4]: F.when(F.col("timestamp_ns") > 30, F.col(vector.VECTOR[4])), vector.VECTOR[37]: F.lit(None).cast("double")})
    got = {r["feature"]: (r["mean"], r["scale"]) for r in results.fit_scales(some).collect()}
    assert list(got) == list(vector.VECTOR) and got[vector.VECTOR[37]] == (None, 1.0)
    for i, n in enumerate(vector.VECTOR[:37]):
        own = [v[i] for k, v in want.items() if i != 4 or k > 30]
        mean = math.fsum(own) / len(own)
        assert got[n] == pytest.approx((mean, max(1.0, math.sqrt(math.fsum((y - mean) ** 2 for y in own) / len(own)))), rel=1e-9)
    assert [tuple(r)[:3] for r in results.fit_scales(dump.limit(0)).collect()] == [(n, None, 1.0) for n in vector.VECTOR]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # its plans show what is compiled only once they ran
    try:
        plan = results.fit_scales(dump)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "HashAggregate" in plan and all("*(" in line for line in plan.splitlines() if "HashAggregate" in line)


def test_results_of_either_form(spark, tmp_path):
    for name, doc, want in (("a", {"returns": [1.0, 2.5], "num_features": 38}, [1.0, 2.5]), ("b", {"trades": [{"pnl": 3.0}, {"x": 1}]}, [3.0]), ("c", {"x": 1}, [])):
        (tmp_path / name).write_text(json.dumps(doc, indent=1))
        assert [r["ret"] for r in results.read_returns(spark, str(tmp_path / name)).orderBy("obs").collect()] == want
    assert results.read_num_features(spark, str(tmp_path / "a")) == 38 and results.read_num_features(spark, str(tmp_path / "b")) == 45


def test_posteriors_are_checked(spark, tmp_path):
    rows = [(1, results.FEATURE_VERSION, s, a, 1, [float("nan")], [0.0], 0) for s in "ABC" for a in ("Buy", "Sell", "Hold")]
    results.write_posteriors(spark.createDataFrame(rows, results.POSTERIOR), str(tmp_path / "p"))
    got = results.read_posteriors(spark, str(tmp_path / "p")).collect()
    assert all(r["mean"] == [0.0] and r["precision"] == [1e-10] for r in got)
    results.write_posteriors(spark.createDataFrame(rows[:8], results.POSTERIOR), str(tmp_path / "q"))
    with pytest.raises(ValueError, match="complete"):
        results.read_posteriors(spark, str(tmp_path / "q"))


def test_verdict_of_short_and_long_series(spark):
    few = spark.createDataFrame([(1, 0.5), (2, float("nan"))], "obs long, ret double")
    assert [tuple(r) for r in validation.verdict(few, 38).collect()] == [("Data Sufficiency", False, 1.0)]
    rng = random.Random(3)
    many = spark.createDataFrame([(i, rng.gauss(0.001, 0.01)) for i in range(200)], "obs long, ret double")
    got = {r["name"]: r for r in validation.verdict(many, 38).collect()}
    assert set(got) == {"Sharpe Ceiling", "Deflated Sharpe Ratio", "Complexity Penalty", "CPCV"}
    level = spark.createDataFrame([(i, 0.0) for i in range(50)], "obs long, ret double")
    assert all(r["value"] == r["value"] for r in validation.verdict(level, 38).collect())


@needs_tables
def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "trade_summary" in capsys.readouterr().out
    assert cli.main(["run", "nothing", "--data", SF]) == 2
    assert cli.main(["run", "strategy_breakdown", "--data", SF, "--strategies", "a", "--out", str(tmp_path / "o")]) == 0
    assert [r["strategy"] for r in spark.read.parquet(str(tmp_path / "o")).collect()] == ["A"]
    assert cli.main(["report", "--data", SF, "--out", str(tmp_path / "r")]) == 0
    assert spark.read.csv(str(tmp_path / "r/performance_summary"), header=True).count() == 7
    (tmp_path / "x.json").write_text('{"returns": [1.0]}')
    assert cli.main(["check", str(tmp_path / "x.json")]) == 1


def test_several_right_sides_in_one_pass_equal_one_after_another(spark):
    rng = random.Random(9)
    times = lambda n: [(i, rng.randrange(400), float(i)) for i in range(n)]
    a, b, c = (spark.createDataFrame(times(n), f"seq long, ts_ns long, {v} double") for n, v in ((90, "x"), (40, "u"), (30, "v")))
    c = c.where("ts_ns > 150")
    both = ordered.asof_all(a, [(b, ["u"]), (c, ["v"])], stretch=35, times=a.select("ts_ns"))
    alone = ordered.asof(ordered.asof(a, b, ["u"], stretch=1000), c, ["v"], stretch=1000)
    assert sorted(map(str, both.collect())) == sorted(map(str, alone.collect()))
    assert both.where("v is null").count() > 0


def test_sums_of_a_span_are_carried_on(spark):
    x = spark.range(20).select(F.col("id").alias("seq"), (F.col("id") * 3).alias("ts_ns"), F.lit(1.0).alias("v"))
    plan = ordered.recent(x.select("seq", "ts_ns"), x, {"s": F.col("v")}, 50)._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame, unboundedpreceding$()" in plan and "RangeFrame, -50" not in plan


@needs_tables
def test_flattening_does_not_join_with_itself(spark):
    import re

    assert not re.search(r"Join \[symbol#\d+, seq#", vector.flatten_unflatten(spark, SF)._jdf.queryExecution().executedPlan().toString())
