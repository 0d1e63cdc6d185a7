"""Operators over ordered events: gaps, anomalies, positions, change points, provider health, learning folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import asof, ema, frame_sums, haloed, lagged, numbered, recent, running, running_max, runs
from ..plans.registry import query, settled, settled_sql
from ..sources.views import SQL, decisions, ticks, trades
from .stats import equity


@query(SQL + """, g AS (SELECT symbol, seq, seq - lag(seq) OVER (PARTITION BY symbol ORDER BY seq) - 1 AS gap FROM ticks)
SELECT symbol, seq, gap, CASE WHEN gap >= 3 THEN 'Severe' ELSE 'Minor' END AS severity FROM g WHERE gap >= 1""")
def seq_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps in the sequence: three or more missing are severe."""
    x = lagged(numbered(ticks(spark, sf_dir).select("symbol", "seq"), ["symbol"]), ["symbol"], {"before": F.col("seq")})
    x = x.select("symbol", "seq", (F.col("seq") - F.col("before") - 1).alias("gap")).where("gap >= 1")
    return x.withColumn("severity", F.when(F.col("gap") >= 3, "Severe").otherwise("Minor"))


@query(SQL + """, i AS (SELECT symbol, seq, ts_ns, CAST(ts_ns - lag(ts_ns) OVER (PARTITION BY symbol ORDER BY seq) AS DOUBLE) AS d FROM ticks),
z AS (SELECT *, count(d) OVER w AS n, (d - avg(d) OVER w) / stddev_samp(d) OVER w AS z FROM i WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 2000 PRECEDING AND 1 PRECEDING))
SELECT symbol, seq, round(z, 4) AS z FROM z WHERE n >= 100 AND abs(z) > 3""")
def tick_interval_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kill switch: intervals more than three deviations off those of the last two thousand, which it does not include."""
    x = haloed(numbered(ticks(spark, sf_dir).select("symbol", "seq", "ts_ns"), ["symbol"]), chunk=16_384, halo=2048)
    w = Window.partitionBy("symbol", "chunk").orderBy("n")
    x = frame_sums(x.withColumn("d", (F.col("ts_ns") - F.lag("ts_ns").over(w)).cast("double")), w, "d", (2000,))
    n, mean, m2 = (F.lag(f"d_{c}_2000").over(w) for c in ("count", "mean", "m2"))
    x = x.withColumns({"before": n, "mean": mean, "m2": m2}).where("own and before > 1 and m2 > 0")
    x = x.select("symbol", "seq", F.col("before").alias("n"), ((F.col("d") - F.col("mean")) / F.sqrt(F.col("m2") / (F.col("before") - 1))).alias("z"))
    return x.where((F.col("n") >= 100) & (F.abs("z") > 3)).select("symbol", "seq", F.round("z", 4).alias("z"))


@query(SQL + """SELECT strategy, seq, CAST(sum(CASE WHEN direction = 'Buy' THEN lots ELSE -lots END) OVER w AS BIGINT) AS position, CAST(sum(pnl_c) OVER w AS BIGINT) AS realized_c FROM trades WINDOW w AS (PARTITION BY strategy ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING)""")
def net_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running net size and realised profit."""
    x = running(numbered(trades(spark, sf_dir), ["strategy"]), ["strategy"], {"position": F.when(F.col("direction") == "Buy", F.col("lots")).otherwise(-F.col("lots")), "realized_c": F.col("pnl_c")})
    return x.select("strategy", "seq", "position", "realized_c")


@query(SQL + """, n AS (SELECT lp_id, ts_ns, seq, k >= 90 AS rejected, row_number() OVER (PARTITION BY lp_id ORDER BY ts_ns, seq) - row_number() OVER (PARTITION BY lp_id, k >= 90 ORDER BY ts_ns, seq) AS island FROM trades),
r AS (SELECT lp_id, island, count(*) AS run FROM n WHERE rejected GROUP BY ALL) SELECT lp_id, max(run) AS longest, count(*) FILTER (run >= 5) AS adversarial_runs FROM r GROUP BY lp_id""")
def consecutive_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of rejections by provider; five in a row are adversarial."""
    t = numbered(trades(spark, sf_dir).select("lp_id", "seq", (F.col("k") >= 90).alias("rejected")), ["lp_id"])
    r = runs(t, ["lp_id"], F.col("rejected")).where("rejected").groupBy("lp_id", "begin").agg(F.count("*").alias("run"))
    return r.groupBy("lp_id").agg(F.max("run").alias("longest"), F.count_if(F.col("run") >= 5).alias("adversarial_runs"))


@query(SQL + """, p AS (SELECT lp_id, seq // 500 AS phase, k < 90 AS filled, slippage FROM trades), a AS (SELECT lp_id, phase, count(*) AS n, avg(CASE WHEN filled THEN 1.0 ELSE 0.0 END) AS rate, avg(slippage) AS slip FROM p GROUP BY ALL)
SELECT b.lp_id, b.phase, b.n, round(b.rate, 8) AS fill_rate, b.n >= 30 AND abs(b.rate - a.rate) < 0.1 AND abs(b.slip - a.slip) < 2e-4 AS complete FROM a b JOIN a ON a.lp_id = b.lp_id AND a.phase = b.phase - 1""")
def recalibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's phase against the one before: enough observations and estimates that have settled."""
    a = trades(spark, sf_dir).groupBy("lp_id", F.expr("seq div 500").alias("phase")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("k") < 90, 1.0).otherwise(0.0)).alias("rate"), F.avg("slippage").alias("slip"))
    b = a.select("lp_id", (F.col("phase") + 1).alias("phase"), F.col("rate").alias("rate0"), F.col("slip").alias("slip0"))
    return a.join(b, ["lp_id", "phase"]).select("lp_id", "phase", "n", F.round("rate", 8).alias("fill_rate"), ((F.col("n") >= 30) & (F.abs(F.col("rate") - F.col("rate0")) < 0.1) & (F.abs(F.col("slip") - F.col("slip0")) < 2e-4)).alias("complete"))


#: Warning and critical thresholds of the surrogate metrics.
THRESHOLDS = (("latency_ms", 1.9, 2.3), ("abs_slippage", 0.0004, 0.0005), ("fill_shortfall", 0.35, 0.45))


@query(SQL + """, m AS (SELECT strategy, ts_ns, seq, unnest(['latency_ms', 'abs_slippage', 'fill_shortfall']) AS metric, unnest([latency_ms, abs(slippage), 1 - fill_probability]) AS v FROM trades),
t AS (SELECT unnest(['latency_ms', 'abs_slippage', 'fill_shortfall']) AS metric, unnest([1.9, 0.0004, 0.35]) AS warn, unnest([2.3, 0.0005, 0.45]) AS crit), x AS (SELECT m.*, v >= warn - 1e-9 AS bad, v >= crit - 1e-9 AS worst FROM m JOIN t USING (metric)),
n AS (SELECT *, row_number() OVER (PARTITION BY strategy, metric ORDER BY ts_ns, seq) - row_number() OVER (PARTITION BY strategy, metric, bad ORDER BY ts_ns, seq) AS island FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY strategy, metric, bad, island ORDER BY ts_ns, seq) AS run FROM n WHERE bad)
SELECT strategy, metric, count(*) FILTER (worst) AS critical, count(*) FILTER (NOT worst) AS warning FROM r WHERE run >= 3 GROUP BY ALL""")
def anomaly_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics against thresholds; an alert needs three bad values in a row."""
    t = trades(spark, sf_dir).select("strategy", "ts_ns", "seq", "latency_ms", F.abs("slippage").alias("abs_slippage"), (1 - F.col("fill_probability")).alias("fill_shortfall"))
    m = t.unpivot(["strategy", "ts_ns", "seq"], [x[0] for x in THRESHOLDS], "metric", "v")
    x = m.join(F.broadcast(spark.createDataFrame(list(THRESHOLDS), "metric string, warn double, crit double")), "metric").withColumns({"bad": F.col("v") >= F.col("warn") - 1e-9, "worst": F.col("v") >= F.col("crit") - 1e-9})
    by = ["strategy", "metric"]
    r = runs(numbered(x.select(*by, "seq", "bad", "worst"), by), by, F.col("bad")).where("bad and n - begin >= 2")
    return r.groupBy(*by).agg(F.count_if("worst").alias("critical"), F.count_if(~F.col("worst")).alias("warning"))


@query(SQL + """, b AS (SELECT symbol, seq // 1000 AS blk, seq, (bid + ask) / 2 AS x FROM ticks), p AS (SELECT symbol, blk, row_number() OVER w AS i, sum(x) OVER w AS s, sum(x) OVER (PARTITION BY symbol, blk) AS total, count(*) OVER (PARTITION BY symbol, blk) AS n FROM b WINDOW w AS (PARTITION BY symbol, blk ORDER BY seq ROWS UNBOUNDED PRECEDING)),
e AS (SELECT symbol, blk, i, abs(s / i - (total - s) / (n - i)) / sqrt(ln(4.0 * (n - 1) / 0.002) / (2.0 * least(i, n - i))) AS score FROM p WHERE i < n)
SELECT symbol, blk, round(max(score), 6) AS score, max(score) > 1 AS change, max(score) >= 2.5 AS major FROM e GROUP BY ALL""")
def adwin_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best split of a window by mean difference against its bound; above one it is a change point."""
    b = ticks(spark, sf_dir).select("symbol", F.expr("seq div 1000").alias("blk"), "seq", ((F.col("bid") + F.col("ask")) / 2).alias("x"))
    w, whole = Window.partitionBy("symbol", "blk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("symbol", "blk")
    p = b.select("symbol", "blk", F.row_number().over(Window.partitionBy("symbol", "blk").orderBy("seq")).alias("i"), F.sum("x").over(w).alias("s"), F.sum("x").over(whole).alias("total"), F.count("*").over(whole).alias("n")).where("i < n")
    score = F.abs(F.col("s") / F.col("i") - (F.col("total") - F.col("s")) / (F.col("n") - F.col("i"))) / F.sqrt(F.log(4.0 * (F.col("n") - 1) / 0.002) / (2.0 * F.least(F.col("i"), F.col("n") - F.col("i"))))
    return p.groupBy("symbol", "blk").agg(F.round(F.max(score), 6).alias("score"), (F.max(score) > 1).alias("change"), (F.max(score) >= 2.5).alias("major"))


@query(SQL + """, e AS (SELECT strategy, seq // 20 AS episode, row_number() OVER (PARTITION BY strategy, seq // 20 ORDER BY ts_ns, seq) - 1 AS i, pnl_c / CAST(10000 AS DOUBLE) AS r FROM trades)
SELECT strategy, episode, count(*) AS n, round(sum(r), 10) AS total, """ + settled_sql("sum(r * pow(0.95, i))", 9) + """ AS g0 FROM e GROUP BY ALL""")
def discounted_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total and discounted return of each episode, by a fold from its end."""
    e = trades(spark, sf_dir).groupBy("strategy", F.expr("seq div 20").alias("episode")).agg(F.array_sort(F.collect_list(F.struct("ts_ns", "seq", (F.col("pnl_c") / 10000.0).alias("r")))).alias("steps"))  # twenty at most
    g = F.aggregate(F.reverse("steps"), F.lit(0.0), lambda acc, s: s["r"] + 0.95 * acc)
    return e.select("strategy", "episode", F.size("steps").cast("bigint").alias("n"), F.round(F.aggregate("steps", F.lit(0.0), lambda acc, s: acc + s["r"]), 10).alias("total"), settled(g, 9).alias("g0"))


@query(SQL + """, e AS (SELECT strategy, seq, ts_ns, k, pnl_c, CAST(sum(pnl_c) OVER w AS BIGINT) AS equity_c FROM trades WINDOW w AS (PARTITION BY strategy ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, coalesce(max(equity_c) OVER (PARTITION BY strategy ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS peak FROM e)
SELECT strategy, seq, round(pnl_c / 1000000.0 - 0.1 * pow(seq % 3, 2) * pow(k / CAST(1000 AS DOUBLE), 2) - 0.5 * least(greatest(greatest(peak, 0) - equity_c, 0) / 1000000.0, 100), 8) AS reward FROM p""")
def episode_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profit less a tenth of the variance of the position held (here seq mod 3 units) and half the fall from the peak before."""
    e = equity(trades(spark, sf_dir))  # below a peak the one before is the same; at one there is no fall
    e = e.withColumn("fall", F.least(F.col("drawdown_c") / 1000000.0, F.lit(100.0)))
    return e.select("strategy", "seq", F.round(F.col("pnl_c") / 1000000.0 - 0.1 * F.pow(F.col("seq") % 3, F.lit(2)) * F.pow(F.col("k") / 1000.0, F.lit(2)) - 0.5 * F.col("fall"), 8).alias("reward"))


@query(SQL + """, x AS (SELECT strategy, k / CAST(100 AS DOUBLE) AS x1, slippage * 1000 AS x2, pnl_c / CAST(10000 AS DOUBLE) AS y FROM trades), s AS (SELECT strategy, 1 + sum(x1 * x1) AS a, sum(x1 * x2) AS b, 1 + sum(x2 * x2) AS d, sum(x1 * y) AS p, sum(x2 * y) AS q FROM x GROUP BY strategy)
SELECT strategy, round((d * p - b * q) / (a * d - b * b), 7) AS w1, round((a * q - b * p) / (a * d - b * b), 7) AS w2 FROM s""")
def blr_two_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bayesian linear regression on two features: posterior mean from grouped sums of outer products."""
    t = trades(spark, sf_dir).select("strategy", (F.col("k") / 100.0).alias("x1"), (F.col("slippage") * 1000).alias("x2"), (F.col("pnl_c") / 10000.0).alias("y"))
    prod = lambda u, v: F.sum(F.col(u) * F.col(v))
    s = t.groupBy("strategy").agg((1 + prod("x1", "x1")).alias("a"), prod("x1", "x2").alias("b"), (1 + prod("x2", "x2")).alias("d"), prod("x1", "y").alias("p"), prod("x2", "y").alias("q"))
    det = F.col("a") * F.col("d") - F.col("b") * F.col("b")
    return s.select("strategy", F.round((F.col("d") * F.col("p") - F.col("b") * F.col("q")) / det, 7).alias("w1"), F.round((F.col("a") * F.col("q") - F.col("b") * F.col("p")) / det, 7).alias("w2"))


@query(SQL + """, t AS (SELECT symbol, seq, ts_ns FROM ticks), s AS (SELECT ts_ns AS sts, strategy, CAST(sum(pnl_c) OVER (PARTITION BY strategy ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS equity_c FROM trades WHERE strategy = 'A')
SELECT t.symbol, t.seq, s.equity_c FROM t ASOF LEFT JOIN s ON t.ts_ns >= s.sts""")
def asof_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quote with the latest state at or before it: a union and the last value within a day, no range join, and no task that sorts all time."""
    s = running(numbered(trades(spark, sf_dir).where("strategy = 'A'"), []), [], {"equity_c": F.col("pnl_c")})
    return asof(ticks(spark, sf_dir).select("symbol", "seq", "ts_ns"), s, ["equity_c"]).select("symbol", "seq", "equity_c")


@query(SQL + "SELECT d.seq, t.symbol, d.direction, round(t.ask - t.bid, 9) AS spread FROM decisions d JOIN ticks t ON t.seq = d.seq WHERE d.triggered AND d.direction IS NOT NULL")
def lineage_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions joined with the quote that caused them."""
    return decisions(spark, sf_dir).where("triggered and direction is not null").select("seq", "direction").join(ticks(spark, sf_dir), "seq").select("seq", "symbol", "direction", F.round(F.col("ask") - F.col("bid"), 9).alias("spread"))


@query(SQL + "SELECT count(*) AS n, count(DISTINCT seq) AS kept FROM (SELECT seq FROM trades UNION ALL SELECT seq FROM trades WHERE k < 50)")
def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that were published twice are seen once."""
    t = trades(spark, sf_dir).select("seq", "k")
    twice = t.union(t.where("k < 50"))
    return twice.groupBy("seq").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("kept"))


@query(SQL + """, r AS (SELECT lp_id, seq, CASE WHEN k < 90 THEN CAST(1 AS DOUBLE) ELSE 0 END AS x, row_number() OVER (PARTITION BY lp_id ORDER BY seq) AS n FROM trades)
SELECT a.lp_id, a.seq, """ + settled_sql("0.8 * pow(CAST(0.9 AS DOUBLE), a.n) + sum(0.1 * pow(CAST(0.9 AS DOUBLE), a.n - b.n) * b.x)", 8) + """ AS ema FROM r a JOIN r b ON a.lp_id = b.lp_id AND b.n BETWEEN a.n - 299 AND a.n GROUP BY a.lp_id, a.seq, a.n""")
def exec_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential mean of a provider's fills, from 0.8, in the order of their numbers."""
    t = numbered(trades(spark, sf_dir).select("lp_id", "seq", (F.col("k") < 90).cast("double").alias("x")), ["lp_id"])
    return ema(t, ["lp_id"], {"ema": ("x", 0.8)}, 0.1).select("lp_id", "seq", settled(F.col("ema"), 8).alias("ema"))


@query(SQL + """, g AS (SELECT symbol, seq, seq - lag(seq) OVER (PARTITION BY symbol ORDER BY seq) - 1 AS gap FROM ticks) SELECT symbol, seq, max(CASE WHEN gap >= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) = 1 AS halted FROM g""")
def gap_halt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a severe gap (here forty missing) a stream stays halted."""
    x = haloed(numbered(ticks(spark, sf_dir).select("symbol", "seq"), ["symbol"]), halo=1)
    gap = F.col("seq") - F.lag("seq").over(Window.partitionBy("symbol", "chunk").orderBy("n")) - 1
    x = x.withColumn("severe", F.coalesce((gap >= 40).cast("int"), F.lit(0))).where("own").drop("chunk", "own")
    return running_max(x, ["symbol"], "severe", "halted").select("symbol", "seq", (F.col("halted") == 1).alias("halted"))


@query(SQL + """, i AS (SELECT symbol, seq, ts_ns, CAST(ts_ns - lag(ts_ns) OVER (PARTITION BY symbol ORDER BY seq) AS DOUBLE) AS d FROM ticks), z AS (SELECT *, count(d) OVER w AS n, (d - avg(d) OVER w) / stddev_samp(d) OVER w AS z FROM i WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 2000 PRECEDING AND 1 PRECEDING)),
a AS (SELECT ts_ns FROM z WHERE n >= 100 AND abs(z) > 3) SELECT t.symbol, t.seq, count(*) AS anomalies FROM ticks t JOIN a ON a.ts_ns BETWEEN t.ts_ns - 60000000000 AND t.ts_ns GROUP BY ALL""")
def kill_switch_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes on which orders are masked: an anomaly of any symbol lies within the mask before them (here a minute)."""
    t = ticks(spark, sf_dir)
    bad = tick_interval_anomaly(spark, sf_dir).join(t.select("symbol", "seq", "ts_ns"), ["symbol", "seq"])
    x = recent(t.select("symbol", "seq", "ts_ns"), bad, {"anomalies": F.lit(1)}, 60_000_000_000)
    return x.where("anomalies > 0").select("symbol", "seq", F.col("anomalies").cast("bigint").alias("anomalies"))
