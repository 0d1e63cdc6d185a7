"""Trade statistics: summary, drawdown, ratios, streaks, funnels, execution quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import frame_sums, haloed, lagged, numbered, running, running_max, runs
from ..plans.registry import ORACLES, query
from ..sources.views import SQL, decisions, trades

YEAR_NS = 31_557_600_000_000_000  # 365.25 days
BY = ["strategy"]


def summary(t: DataFrame, by: list[str] = BY) -> DataFrame:
    """Totals, win rate, average win and loss, profit factor, execution means; a zero profit is neither win nor loss."""
    p = F.col("pnl_c")
    wins, losses = F.sum(F.when(p > 0, p).otherwise(0)), F.sum(F.when(p < 0, p).otherwise(0))
    n = F.count("*")
    return t.groupBy(*by).agg(
        n.alias("n"), F.count_if(p > 0).alias("n_win"), F.count_if(p < 0).alias("n_loss"), F.sum(p).alias("total_pnl_c"),
        F.round(F.count_if(p > 0) / n, 9).alias("win_rate"), F.round(F.avg(F.when(p > 0, p)), 6).alias("avg_win_c"), F.round(F.avg(F.when(p < 0, p)), 6).alias("avg_loss_c"),
        F.when(losses < 0, F.round(wins / -losses, 9)).when(wins > 0, F.lit(float("inf"))).otherwise(0.0).alias("profit_factor"),
        F.round(F.avg(F.abs("slippage")), 9).alias("avg_slippage"), F.round(F.avg("fill_probability"), 9).alias("avg_fill_probability"), F.round(F.avg("latency_ms"), 9).alias("avg_latency_ms"),
        F.when(n > 1, F.expr("(max(ts_ns) - min(ts_ns)) div (count(*) - 1)")).otherwise(0).alias("avg_interval_ns"),
    )


@query(SQL + """SELECT strategy, count(*) AS n, count(*) FILTER (pnl_c > 0) AS n_win, count(*) FILTER (pnl_c < 0) AS n_loss, CAST(sum(pnl_c) AS BIGINT) AS total_pnl_c,
 round(count(*) FILTER (pnl_c > 0) / count(*), 9) AS win_rate, round(avg(pnl_c) FILTER (pnl_c > 0), 6) AS avg_win_c, round(avg(pnl_c) FILTER (pnl_c < 0), 6) AS avg_loss_c,
 CASE WHEN sum(least(pnl_c, 0)) < 0 THEN round(sum(greatest(pnl_c, 0)) / -sum(least(pnl_c, 0)), 9) WHEN sum(greatest(pnl_c, 0)) > 0 THEN CAST('Infinity' AS DOUBLE) ELSE 0 END AS profit_factor,
 round(avg(abs(slippage)), 9) AS avg_slippage, round(avg(fill_probability), 9) AS avg_fill_probability, round(avg(latency_ms), 9) AS avg_latency_ms,
 CASE WHEN count(*) > 1 THEN (max(ts_ns) - min(ts_ns)) // (count(*) - 1) ELSE 0 END AS avg_interval_ns FROM trades GROUP BY strategy""")
def trade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(trades(spark, sf_dir))


@query(SQL + "SELECT strategy, count(*) AS n, CAST(sum(pnl_c) AS BIGINT) AS total_pnl_c, round(count(*) FILTER (pnl_c > 0) / count(*), 9) AS win_rate, round(avg(pnl_c), 6) AS avg_pnl_c FROM trades GROUP BY strategy")
def strategy_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("pnl_c")
    return trades(spark, sf_dir).groupBy("strategy").agg(F.count("*").alias("n"), F.sum(p).alias("total_pnl_c"), F.round(F.count_if(p > 0) / F.count("*"), 9).alias("win_rate"), F.round(F.avg(p), 6).alias("avg_pnl_c"))


def equity(t: DataFrame, by: list[str] = BY, *more: str) -> DataFrame:
    """Running equity, its peak (from 0) and the drawdown, in order of ``seq``; with the rows' number if ``more`` is ``n``."""
    e = running_max(running(numbered(t, by), by, {"equity_c": F.col("pnl_c")}), by, "equity_c", "peak_c")
    return e.withColumn("peak_c", F.greatest(F.lit(0), "peak_c")).withColumn("drawdown_c", F.col("peak_c") - F.col("equity_c")).select(*t.columns, "equity_c", "peak_c", "drawdown_c", *more)


EQUITY = SQL + """, eq AS (SELECT *, CAST(sum(pnl_c) OVER w AS BIGINT) AS equity_c FROM trades WINDOW w AS (PARTITION BY strategy ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING)),
dd AS (SELECT *, greatest(0, max(equity_c) OVER w) AS peak_c, greatest(0, max(equity_c) OVER w) - equity_c AS drawdown_c FROM eq WINDOW w AS (PARTITION BY strategy ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING))
"""


@query(EQUITY + "SELECT strategy, seq, ts_ns, equity_c, drawdown_c FROM dd")
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equity(trades(spark, sf_dir)).select("strategy", "seq", "ts_ns", "equity_c", "drawdown_c")


@query(EQUITY + "SELECT strategy, max(drawdown_c) AS max_drawdown_c FROM dd GROUP BY strategy")
def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equity(trades(spark, sf_dir)).groupBy("strategy").agg(F.max("drawdown_c").alias("max_drawdown_c"))


def drawdown_length(t: DataFrame, by: list[str] = BY) -> DataFrame:
    """Longest time from a peak to its recovery, or to the last trade without one; the first trade's time is the first peak's."""
    e = equity(t, by, "n").withColumn("at_peak", F.col("drawdown_c") == 0)
    e = running_max(e.withColumn("__ts", F.when(F.col("at_peak") | (F.col("n") == 1), F.col("ts_ns"))), by, "__ts", "__last")
    e = lagged(e, by, {"peak_ts": F.col("__last"), "was_at_peak": F.col("at_peak")})
    e = e.withColumns({"peak_ts": F.coalesce("peak_ts", "ts_ns"), "was_at_peak": F.coalesce("was_at_peak", F.lit(True))})
    return e.groupBy(*by).agg(F.coalesce(F.max(F.when(~F.col("at_peak") | ~F.col("was_at_peak"), F.col("ts_ns") - F.col("peak_ts"))), F.lit(0)).alias("longest_drawdown_ns"))


@query(EQUITY + """, pk AS (SELECT *, equity_c >= greatest(0, coalesce(max(equity_c) OVER b, 0)) AS at_peak, first_value(ts_ns) OVER (PARTITION BY strategy ORDER BY ts_ns, seq) AS first_ts FROM eq WINDOW b AS (PARTITION BY strategy ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pt AS (SELECT *, coalesce(max(CASE WHEN at_peak THEN ts_ns END) OVER (PARTITION BY strategy ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_ts) AS peak_ts, coalesce(lag(at_peak) OVER (PARTITION BY strategy ORDER BY ts_ns, seq), true) AS was FROM pk)
SELECT strategy, coalesce(max(CASE WHEN NOT at_peak OR NOT was THEN ts_ns - peak_ts END), 0) AS longest_drawdown_ns FROM pt GROUP BY strategy""")
def drawdown_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawdown_length(trades(spark, sf_dir))


def closing(t: DataFrame, by: list[str] = BY) -> DataFrame:
    """Trades that ratios count: those that close a position, or all where none does. A semi-join on the keys that have one, no window."""
    keys = t.where("close_reason is not null").select(*by).distinct().withColumn("closes", F.lit(True))
    return t.join(keys, by, "left").where("close_reason is not null or closes is null").drop("closes")


def _scale(n: Column) -> Column:
    """Square root of trades a year, from the mean time between them."""
    span = F.max("ts_ns") - F.min("ts_ns")
    return F.sqrt(F.when(span > 0, F.greatest(F.lit(float(YEAR_NS)) / (span / (n - 1)), F.lit(1.0))).otherwise(1.0))


CLOSING = SQL + ", cl AS (SELECT * FROM trades t WHERE close_reason IS NOT NULL OR NOT EXISTS (SELECT 1 FROM trades u WHERE u.strategy = t.strategy AND u.close_reason IS NOT NULL))\n"
SCALE = f"sqrt(CASE WHEN max(ts_ns) > min(ts_ns) THEN greatest(CAST({YEAR_NS} AS DOUBLE) / ((max(ts_ns) - min(ts_ns)) / (count(*) - 1)), 1) ELSE 1 END)"


@query(CLOSING + f"SELECT strategy, CASE WHEN count(*) < 2 OR stddev_samp(pnl_c) < 1e-12 THEN 0 ELSE round(avg(pnl_c) / stddev_samp(pnl_c) * {SCALE}, 6) END AS sharpe FROM cl GROUP BY strategy")
def sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, sd = F.count("*"), F.stddev_samp("pnl_c")
    return closing(trades(spark, sf_dir)).groupBy("strategy").agg(F.when((n < 2) | (sd < 1e-12), 0.0).otherwise(F.round(F.avg("pnl_c") / sd * _scale(n), 6)).alias("sharpe"))


@query(CLOSING + f""", m AS (SELECT strategy, avg(pnl_c) AS mean FROM cl GROUP BY strategy)
SELECT cl.strategy, CASE WHEN count(*) < 2 OR sum(CASE WHEN pnl_c < mean THEN (pnl_c - mean) * (pnl_c - mean) ELSE 0 END) = 0 THEN 0
 ELSE round(avg(pnl_c) / sqrt(sum(CASE WHEN pnl_c < mean THEN (pnl_c - mean) * (pnl_c - mean) ELSE 0 END) / count(*)) * {SCALE}, 6) END AS sortino FROM cl JOIN m USING (strategy) GROUP BY cl.strategy""")
def sortino(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downside is below the mean, divided by all."""
    c = closing(trades(spark, sf_dir))
    d = c.join(c.groupBy("strategy").agg(F.avg("pnl_c").alias("mean")), "strategy").withColumn("d", F.least(F.col("pnl_c") - F.col("mean"), F.lit(0.0)))
    n = F.count("*")
    down = F.sqrt(F.sum(F.col("d") * F.col("d")) / n)
    return d.groupBy("strategy").agg(F.when((n < 2) | (down == 0), 0.0).otherwise(F.round(F.avg("pnl_c") / down * _scale(n), 6)).alias("sortino"))


def longest_runs(t: DataFrame, by: list[str] = BY) -> DataFrame:
    """Longest runs of wins and of losses; a zero ends both."""
    x = numbered(t.select(*by, "seq", F.signum(F.col("pnl_c").cast("double")).cast("int").alias("s")), by)
    each = runs(x, by, F.col("s")).groupBy(*by, "s", "begin").agg(F.count("*").alias("n"))
    return each.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("s") > 0, F.col("n"))), F.lit(0)).alias("win_streak"), F.coalesce(F.max(F.when(F.col("s") < 0, F.col("n"))), F.lit(0)).alias("loss_streak"))


@query(SQL + """, x AS (SELECT strategy, sign(pnl_c) AS s, row_number() OVER (PARTITION BY strategy ORDER BY ts_ns, seq) - row_number() OVER (PARTITION BY strategy, sign(pnl_c) ORDER BY ts_ns, seq) AS island FROM trades),
r AS (SELECT strategy, s, island, count(*) AS n FROM x GROUP BY ALL)
SELECT strategy, coalesce(max(n) FILTER (s > 0), 0) AS win_streak, coalesce(max(n) FILTER (s < 0), 0) AS loss_streak FROM r GROUP BY strategy""")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_runs(trades(spark, sf_dir))


PARTS = ("trade_summary", "max_drawdown", "drawdown_duration", "sharpe", "sortino", "streaks")


@query("SELECT *, total_pnl_c AS realized_pnl_c FROM " + " JOIN ".join(f"({ORACLES[p]}) p{i}" + (" USING (strategy)" if i else "") for i, p in enumerate(PARTS)))
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole summary of each strategy's run, one row for each; every profit of a run is realised."""
    parts = [f(spark, sf_dir) for f in (trade_summary, max_drawdown, drawdown_duration, sharpe, sortino, streaks)]
    return reduce(lambda a, b: a.join(b, "strategy"), parts).withColumn("realized_pnl_c", F.col("total_pnl_c"))


@query(SQL + """SELECT coalesce(lp_id, 'ALL') AS lp_id, count(*) AS requests, count(*) FILTER (k < 90) AS fills, count(*) FILTER (k >= 90) AS rejections, round(count(*) FILTER (k < 90) / count(*), 9) AS fill_rate,
 round(count(*) FILTER (k >= 90) / count(*), 9) AS rejection_rate, round(avg(abs(slippage)), 9) AS avg_slippage FROM trades GROUP BY ROLLUP (lp_id)""")
def lp_execution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill and rejection rates of each liquidity provider and of all."""
    filled = F.col("k") < 90
    n = F.count("*")
    return trades(spark, sf_dir).rollup("lp_id").agg(
        n.alias("requests"), F.count_if(filled).alias("fills"), F.count_if(~filled).alias("rejections"), F.round(F.count_if(filled) / n, 9).alias("fill_rate"), F.round(F.count_if(~filled) / n, 9).alias("rejection_rate"), F.round(F.avg(F.abs("slippage")), 9).alias("avg_slippage")
    ).withColumn("lp_id", F.coalesce("lp_id", F.lit("ALL")))


@query(SQL + """SELECT coalesce(strategy, 'ALL') AS strategy, count(*) AS total, count(*) FILTER (triggered) AS n_triggered, count(*) FILTER (direction IS NOT NULL) AS entry_attempts,
 count(*) FILTER (direction IS NOT NULL AND skip_reason IS NULL) AS filled, count(*) FILTER (direction IS NULL AND skip_reason IS NULL) AS holds FROM decisions GROUP BY ROLLUP (strategy)""")
def decision_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = F.col("direction").isNotNull(), F.col("skip_reason").isNull()
    return decisions(spark, sf_dir).rollup("strategy").agg(
        F.count("*").alias("total"), F.count_if("triggered").alias("n_triggered"), F.count_if(d).alias("entry_attempts"), F.count_if(d & s).alias("filled"), F.count_if(~d & s).alias("holds")
    ).withColumn("strategy", F.coalesce("strategy", F.lit("ALL")))


@query(SQL + """, c AS (SELECT strategy, skip_reason, count(*) AS n FROM decisions WHERE skip_reason IS NOT NULL GROUP BY ALL)
SELECT strategy, skip_reason, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY n DESC, skip_reason) AS rank FROM c) WHERE rank <= 3""")
def skip_reason_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three commonest reasons to skip of each strategy; ties by name."""
    c = decisions(spark, sf_dir).where("skip_reason is not null").groupBy("strategy", "skip_reason").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("n"), "skip_reason")).cast("bigint")).where("rank <= 3")


STAGES = {"evaluated": "true", "n_triggered": "triggered", "attempted": "triggered and direction is not null", "risk_passed": "triggered and direction is not null and (skip_reason is null or skip_reason = 'execution_rejected')", "filled": "triggered and direction is not null and skip_reason is null", "closed": "triggered and direction is not null and skip_reason is null and close_reason is not null"}


@query(SQL + "SELECT s.strategy, " + ", ".join(f"count(*) FILTER (d.seq IS NOT NULL AND ({v})) AS {k}" for k, v in STAGES.items()) + " FROM (SELECT unnest(['A', 'B', 'C']) AS strategy) s LEFT JOIN decisions d USING (strategy) GROUP BY s.strategy")
def strategy_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by stage, with zeros for a strategy without decisions."""
    every = spark.createDataFrame([("A",), ("B",), ("C",)], "strategy string")
    counts = decisions(spark, sf_dir).groupBy("strategy").agg(*[F.count_if(F.expr(v)).alias(k) for k, v in STAGES.items()])
    return every.join(counts, "strategy", "left").fillna(0)


@query(SQL + """, w AS (SELECT strategy, seq, CAST(sum(pnl_c) OVER a AS BIGINT) AS cumulative_c, avg(pnl_c) OVER r AS m, stddev_samp(pnl_c) OVER r AS s, avg(CASE WHEN pnl_c > 0 THEN 1.0 ELSE 0.0 END) OVER a AS win FROM trades
 WINDOW a AS (PARTITION BY strategy ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING), r AS (PARTITION BY strategy ORDER BY ts_ns, seq ROWS 99 PRECEDING))
SELECT strategy, seq, cumulative_c, CASE WHEN s > 1e-9 THEN round(m / s * sqrt(252), 6) ELSE 0 END AS rolling_sharpe, round(win, 6) AS win_rate FROM w""")
def tracker_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live tracker: cumulative profit, Sharpe of the last 100 trades, win rate so far."""
    x = running(numbered(trades(spark, sf_dir).select("strategy", "seq", "pnl_c"), BY), BY, {"cumulative_c": F.col("pnl_c"), "wins": (F.col("pnl_c") > 0).cast("int")})
    x = frame_sums(haloed(x, halo=100), Window.partitionBy("strategy", "chunk").orderBy("n"), "pnl_c", (100,)).where("own")
    s = F.when(F.col("pnl_c_count_100") > 1, F.sqrt(F.col("pnl_c_m2_100") / (F.col("pnl_c_count_100") - 1)))
    return x.select(
        "strategy", "seq", "cumulative_c", F.when(s > 1e-9, F.round(F.col("pnl_c_mean_100") / s * F.sqrt(F.lit(252.0)), 6)).otherwise(0.0).alias("rolling_sharpe"),
        F.round(F.col("wins") / F.col("n"), 6).alias("win_rate"),
    )


@query(SQL + """SELECT lp_id, count(*) AS n, round(avg(slippage), 9) AS mean, round(var_pop(slippage), 12) AS variance, 2 + count(*) FILTER (k < 90) AS alpha, 1 + count(*) FILTER (k >= 90) AS beta,
 round((2 + count(*) FILTER (k < 90)) / (3 + count(*)), 9) AS p_mean,
 round((2 + count(*) FILTER (k < 90)) * (1 + count(*) FILTER (k >= 90)) / (CAST(3 + count(*) AS DOUBLE) * (3 + count(*)) * (4 + count(*))), 12) AS p_variance FROM trades GROUP BY lp_id""")
def lp_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slippage mean and variance, and the Beta posterior of the fill probability, by provider."""
    f, r, n = F.count_if(F.col("k") < 90), F.count_if(F.col("k") >= 90), F.count("*")
    a, b = 2 + f, 1 + r
    t = (3 + n).cast("double")
    return trades(spark, sf_dir).groupBy("lp_id").agg(
        n.alias("n"), F.round(F.avg("slippage"), 9).alias("mean"), F.round(F.var_pop("slippage"), 12).alias("variance"), a.alias("alpha"), b.alias("beta"),
        F.round(a / t, 9).alias("p_mean"), F.round(a * b / (t * t * (t + 1)), 12).alias("p_variance"),
    )


@query(SQL + """, m AS (SELECT strategy, seq % 2 AS half, CAST(sum(pnl_c) AS DOUBLE) AS pnl, count(*) FILTER (pnl_c > 0) / count(*) AS win, avg(abs(slippage)) AS slip, avg(latency_ms) AS latency FROM trades GROUP BY ALL),
l AS (SELECT strategy, half, unnest(['pnl', 'win_rate', 'slippage', 'latency']) AS metric, unnest([pnl, win, slip, latency]) AS v FROM m)
SELECT b.strategy, b.metric, round(b.v, 6) AS backtest, round(f.v, 6) AS forward, round(CASE WHEN b.metric = 'pnl' THEN CASE WHEN b.v = 0 AND f.v = 0 THEN 0 WHEN b.v = 0 THEN CAST('Infinity' AS DOUBLE) ELSE abs(f.v - b.v) / abs(b.v) END ELSE abs(f.v - b.v) END, 6) AS diff,
 CASE WHEN b.metric = 'pnl' THEN CASE WHEN b.v = 0 AND f.v = 0 THEN 0 WHEN b.v = 0 THEN CAST('Infinity' AS DOUBLE) ELSE abs(f.v - b.v) / abs(b.v) END ELSE abs(f.v - b.v) END <= CASE b.metric WHEN 'pnl' THEN 0.2 WHEN 'win_rate' THEN 0.1 ELSE 0.3 END AS passed
FROM l b JOIN l f USING (strategy, metric) WHERE b.half = 0 AND f.half = 1""")
def bt_fw_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' metrics side by side: relative difference for profit, absolute for the others, against thresholds."""
    t = trades(spark, sf_dir).withColumn("half", F.col("seq") % 2)
    m = t.groupBy("strategy", "half").agg(F.sum("pnl_c").cast("double").alias("pnl"), (F.count_if(F.col("pnl_c") > 0) / F.count("*")).alias("win_rate"), F.avg(F.abs("slippage")).alias("slippage"), F.avg("latency_ms").alias("latency"))
    long = m.unpivot(["strategy", "half"], ["pnl", "win_rate", "slippage", "latency"], "metric", "v")
    b, f = long.where("half = 0").select("strategy", "metric", F.col("v").alias("b")), long.where("half = 1").select("strategy", "metric", F.col("v").alias("f"))
    diff = F.abs(F.col("f") - F.col("b"))
    relative = F.when((F.col("b") == 0) & (F.col("f") == 0), 0.0).when(F.col("b") == 0, F.lit(float("inf"))).otherwise(diff / F.abs("b"))
    d = F.when(F.col("metric") == "pnl", relative).otherwise(diff)
    most = F.when(F.col("metric") == "pnl", 0.2).when(F.col("metric") == "win_rate", 0.1).otherwise(0.3)
    return b.join(f, ["strategy", "metric"]).select("strategy", "metric", F.round("b", 6).alias("backtest"), F.round("f", 6).alias("forward"), F.round(d, 6).alias("diff"), (d <= most).alias("passed"))
