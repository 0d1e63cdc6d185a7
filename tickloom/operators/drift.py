"""Signs of trouble in a model: restless and indifferent decisions, costs misjudged, latency and costs that creep, features whose distribution moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import frame_slopes, frame_sums, haloed, numbered
from ..plans.registry import query, settled, settled_sql
from ..sources.views import SQL, decisions, ticks
from .execution import expected_slippage
from .runtime import FRAME

#: Relative change of an action's value that counts as an adjustment, and the least value it is relative to.
ADJUSTED, LEAST_VALUE = 0.05, 1e-6
MODEL_METRICS = ("q_value_adjustment_frequency", "policy_entropy", "dynamic_cost_estimate_error", "rolling_variance_latency", "hidden_liquidity_sigma")
TRENDS = ("latency_ms", "slippage", "cost_error")


def softmax_entropy(scores: list[Column]) -> Column:
    """Entropy in nats of the softmax of a few scores, stabilised by their greatest."""
    top = F.greatest(*scores)
    e = [F.exp(s - top) for s in scores]
    total = sum(e[1:], e[0])
    # -sum(p ln p) with ln p = s - top - ln(total)
    return F.log(total) - sum((x * (s - top) for x, s in zip(e, scores, strict=True)), F.lit(0.0)) / total


def observed(d: DataFrame) -> DataFrame:
    """Decisions in chunks with what is measured of each: adjusted (0 or 1), policy_entropy of buy, sell and hold, cost_error."""
    x = haloed(numbered(d, ["strategy"]))
    q, was = F.col("q_sampled"), F.lag("q_sampled").over(Window.partitionBy("strategy", "chunk").orderBy("n"))
    change = F.round(F.abs(q - was) / F.greatest(F.abs(was), F.lit(LEAST_VALUE)), 9)  # sell is -q and hold 0, so the greatest change is that of q
    cost = expected_slippage(F.col("k") / 100.0, F.col("lots") / 100000.0, F.col("direction") == "Sell", F.lit(0.0))
    return x.withColumns({"adjusted": F.when(change > ADJUSTED, 1.0).otherwise(0.0), "policy_entropy": softmax_entropy([q, -q, F.lit(0.0)]), "cost_error": F.abs(F.abs(cost) - F.abs("slippage"))})


def model_metrics(d: DataFrame) -> DataFrame:
    """After each decision of a strategy, over its last 256: share of adjusted values, mean error of costs, deviations of latency and of slippage; and the entropy of the policy now."""
    w, x = Window.partitionBy("strategy", "chunk").orderBy("n"), observed(d)
    x = frame_sums(x, w, ("adjusted", "cost_error", "latency_ms", "slippage"), (FRAME,))
    n, m2 = F.col(f"latency_ms_count_{FRAME}"), F.col(f"latency_ms_m2_{FRAME}")
    return x.where("own").withColumns({
        "q_value_adjustment_frequency": F.col(f"adjusted_mean_{FRAME}"), "dynamic_cost_estimate_error": F.col(f"cost_error_mean_{FRAME}"),
        "rolling_variance_latency": F.coalesce(F.sqrt(F.try_divide(m2, n - 1)), F.lit(0.0)), "hidden_liquidity_sigma": F.sqrt(F.col(f"slippage_m2_{FRAME}") / F.col(f"slippage_count_{FRAME}")),
    })


def metric_slopes(d: DataFrame) -> DataFrame:
    """Slopes of latency, slippage and error of costs over a strategy's last 256 decisions, for each decision; null for its first."""
    w, x = Window.partitionBy("strategy", "chunk").orderBy("n"), observed(d)
    return frame_slopes(x, w, TRENDS, (FRAME,)).where("own")


OBSERVED = SQL + f""", ob AS (SELECT *, row_number() OVER o AS n, CASE WHEN round(abs(q_sampled - lag(q_sampled) OVER o) / greatest(abs(lag(q_sampled) OVER o), {LEAST_VALUE}), 9) > {ADJUSTED} THEN CAST(1 AS DOUBLE) ELSE 0 END AS adjusted,
 exp(q_sampled - abs(q_sampled)) AS eb, exp(-q_sampled - abs(q_sampled)) AS es, exp(-abs(q_sampled)) AS eh,
 abs(abs(k / CAST(100 AS DOUBLE) * (CAST(1e-4 AS DOUBLE) + 0.01 + 0.001) - CASE WHEN direction = 'Sell' THEN CAST(5e-5 AS DOUBLE) ELSE 0 END) - abs(slippage)) AS cost_error FROM decisions WINDOW o AS (PARTITION BY strategy ORDER BY seq))
"""


@query(OBSERVED + f"""SELECT strategy, seq, {settled_sql("avg(adjusted) OVER w", 8)} AS q_value_adjustment_frequency, {settled_sql("-(eb / (eb + es + eh) * ln(eb / (eb + es + eh)) + es / (eb + es + eh) * ln(es / (eb + es + eh)) + eh / (eb + es + eh) * ln(eh / (eb + es + eh)))", 8)} AS policy_entropy,
 {settled_sql("avg(cost_error) OVER w", 8)} AS dynamic_cost_estimate_error, {settled_sql("coalesce(stddev_samp(latency_ms) OVER w, 0)", 8)} AS rolling_variance_latency, {settled_sql("stddev_pop(slippage) OVER w", 8)} AS hidden_liquidity_sigma FROM ob WINDOW w AS (PARTITION BY strategy ORDER BY seq ROWS {FRAME - 1} PRECEDING)""")
def model_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_metrics(decisions(spark, sf_dir)).select("strategy", "seq", *[settled(F.col(m), 8).alias(m) for m in MODEL_METRICS])


@query(OBSERVED + "SELECT strategy, seq, " + ", ".join(settled_sql(f"regr_slope({c}, n) OVER w", 8) + f" AS {c}_trend" for c in TRENDS) + f" FROM ob WINDOW w AS (PARTITION BY strategy ORDER BY seq ROWS {FRAME - 1} PRECEDING)")
def metric_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_slopes(decisions(spark, sf_dir)).select("strategy", "seq", *[settled(F.col(f"{c}_slope_{FRAME}"), 8).alias(f"{c}_trend") for c in TRENDS])


#: Bins of a histogram, half a deviation each, the outer ones open; a share below which a bin counts as empty; nanoseconds of a period.
BINS, NONE, WEEK = 12, 1e-12, 7 * 86_400_000_000_000


def histograms(x: DataFrame, keys: list[str], period: str, value: str, first: DataFrame) -> DataFrame:
    """(keys, period, bin, n) of ``value``: bins lie about the mean of the reference (keys, period) in ``first``, in its deviations; nulls are left out.

    Counts are added up before the shuffle, so what travels is a row for each
    task, key, period and bin.
    """
    x = x.where(F.col(value).isNotNull())
    scale = x.join(first, [*keys, period], "left_semi").groupBy(*keys).agg(F.avg(value).alias("__mid"), F.greatest(F.stddev_pop(value), F.lit(1e-12)).alias("__sd"))
    at = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(F.round((F.col(value) - F.col("__mid")) / F.col("__sd") * 2, 6)) + BINS // 2)).cast("int")
    return x.join(scale, keys).groupBy(*keys, period, at.alias("bin")).agg(F.count("*").alias("n"))


def divergence(h: DataFrame, keys: list[str], period: str, first: DataFrame) -> DataFrame:
    """(keys, period, rows, kl, l2): Kullback-Leibler divergence, in which empty bins of either side are skipped, and Euclidean distance of each period's shares from the reference's."""
    filled = F.map_from_entries(F.collect_list(F.struct("bin", "n")))  # as many as there are bins
    share = lambda m, b: F.coalesce(F.element_at(m, b), F.lit(0)) / F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda a, v: a + v)
    each = h.groupBy(*keys, period).agg(filled.alias("__m"), F.sum("n").alias("rows"))
    each = each.withColumn("__p", F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: share(F.col("__m"), b)))
    base = each.join(first, [*keys, period], "left_semi").select(*keys, F.col("__p").alias("__q"))
    pairs = F.arrays_zip("__p", "__q")
    kl = F.aggregate(pairs, F.lit(0.0), lambda a, z: a + F.when((z["__p"] > NONE) & (z["__q"] > NONE), z["__p"] * F.log(F.try_divide(z["__p"], z["__q"]))).otherwise(0.0))
    l2 = F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda a, z: a + (z["__p"] - z["__q"]) * (z["__p"] - z["__q"])))
    return each.join(base, keys).select(*keys, period, "rows", kl.alias("kl"), l2.alias("l2"))


@query(SQL + f""", v AS (SELECT symbol, ts_ns // {WEEK} AS period, unnest(['mid', 'spread', 'imbalance']) AS feature, unnest([(bid + ask) / 2, ask - bid, (bid_size - ask_size) / (bid_size + ask_size)]) AS x FROM ticks), f AS (SELECT symbol, feature, min(period) AS period FROM v GROUP BY ALL),
s AS (SELECT symbol, feature, avg(x) AS mid, greatest(stddev_pop(x), 1e-12) AS sd FROM v JOIN f USING (symbol, feature, period) GROUP BY ALL),
h AS (SELECT symbol, feature, period, CAST(greatest(0, least({BINS - 1}, floor(round((x - mid) / sd * 2, 6)) + {BINS // 2})) AS INT) AS bin, count(*) AS n FROM v JOIN s USING (symbol, feature) GROUP BY ALL),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY symbol, feature, period) AS p, sum(n) OVER (PARTITION BY symbol, feature, period) AS rows FROM h), q AS (SELECT symbol, feature, bin, p AS q FROM p JOIN f USING (symbol, feature, period)),
g AS (SELECT k.symbol, k.feature, k.period, k.rows, b.bin, coalesce(p.p, 0) AS p, coalesce(q.q, 0) AS q FROM (SELECT DISTINCT symbol, feature, period, rows FROM p) k CROSS JOIN (SELECT range AS bin FROM range({BINS})) b LEFT JOIN p ON p.symbol = k.symbol AND p.feature = k.feature AND p.period = k.period AND p.bin = b.bin LEFT JOIN q ON q.symbol = k.symbol AND q.feature = k.feature AND q.bin = b.bin)
SELECT symbol, feature, period, CAST(any_value(rows) AS BIGINT) AS rows, {settled_sql(f"sum(CASE WHEN p > {NONE} AND q > {NONE} THEN p * ln(p / q) ELSE 0 END)", 8)} AS kl, {settled_sql("sqrt(sum((p - q) * (p - q)))", 8)} AS l2 FROM g GROUP BY symbol, feature, period""")
def feature_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each week's mid, spread and imbalance of a symbol have moved from those of its first week."""
    t = ticks(spark, sf_dir)
    x = t.select("symbol", F.expr(f"ts_ns div {WEEK}").alias("period"), ((F.col("bid") + F.col("ask")) / 2).alias("mid"), (F.col("ask") - F.col("bid")).alias("spread"), ((F.col("bid_size") - F.col("ask_size")) / (F.col("bid_size") + F.col("ask_size"))).alias("imbalance"))
    x = x.unpivot(["symbol", "period"], ["mid", "spread", "imbalance"], "feature", "x")
    keys = ["symbol", "feature"]
    first = x.groupBy(*keys).agg(F.min("period").alias("period"))
    d = divergence(histograms(x, keys, "period", "x", first), keys, "period", first)
    return d.select(*keys, "period", "rows", settled(F.col("kl"), 8).alias("kl"), settled(F.col("l2"), 8).alias("l2"))
