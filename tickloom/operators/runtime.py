"""What runs around a strategy: event headers, schemas and their versions, snapshots, alerts, health of providers and feeds, forced closes, funnels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import carried_last, ema, frame_sums, haloed, numbered, running, running_max
from ..plans.registry import query, settled, settled_sql
from ..sources.views import SQL, decisions, ticks, trades
from .features import FEATURES, features
from .risk import DAILY_C, MONTHLY_C, PERIODS, WEEKLY_C, period_profit

STRATEGIES = ("A", "B", "C")


def parse_strategies(text: str) -> list[str]:
    """A comma list of strategies in any case; an unknown or empty one is an error."""
    out = [x.strip().upper() for x in text.split(",")]
    bad = [x for x in out if x not in STRATEGIES]
    if bad:
        raise ValueError(f"unknown strategy {bad[0]!r}; one of {', '.join(STRATEGIES)}")
    return sorted(set(out))


@query(SQL + "SELECT strategy, count(*) AS n FROM trades WHERE strategy IN ('A', 'C') GROUP BY strategy")
def enabled_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades(spark, sf_dir).where(F.col("strategy").isin(parse_strategies("c, A"))).groupBy("strategy").agg(F.count("*").alias("n"))


@query(SQL + "SELECT symbol, seq, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS sequence_id, 'market' AS stream, CAST(1 AS BIGINT) AS schema_version FROM ticks")
def event_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes as events: each stream counts from one, whatever the partitions."""
    return numbered(ticks(spark, sf_dir), ["symbol"]).select("symbol", "seq", F.col("n").cast("bigint").alias("sequence_id"), F.lit("market").alias("stream"), F.lit(1).cast("bigint").alias("schema_version"))


class SchemaRegistry:
    """Descriptions of event types by version; what is registered stays as it is. Upcasters go one version up each and compose."""

    def __init__(self) -> None:
        self.schemas: dict[tuple[str, int], str] = {}
        self.steps: dict[tuple[str, int], Callable[[DataFrame], DataFrame]] = {}

    def register(self, kind: str, version: int, description: str = "") -> None:
        if (kind, version) in self.schemas:
            raise ValueError(f"{kind} v{version} is registered already")
        self.schemas[kind, version] = description

    def versions(self, kind: str) -> list[int]:
        return sorted(v for k, v in self.schemas if k == kind)

    def latest(self, kind: str) -> int | None:
        return max(self.versions(kind), default=None)

    def upcaster(self, kind: str, version: int, step: Callable[[DataFrame], DataFrame]) -> None:
        self.steps[kind, version] = step

    def upcast(self, df: DataFrame, kind: str, version: str = "version") -> DataFrame:
        """All rows at the latest version: each step sees the rows that have reached its version. A step that is missing is an error."""
        latest = self.latest(kind)
        if latest is None:
            raise ValueError(f"no schema of {kind}")
        for v in self.versions(kind):
            if v == latest:
                return df
            step = self.steps.get((kind, v))
            if step is None:
                raise ValueError(f"no upcaster of {kind} v{v} to v{v + 1}")
            due, was = F.col(version) == v, set(df.columns)
            new = step(df.withColumns({f"__was_{c}": F.col(c) for c in was}))
            kept = [c for c in new.columns if not c.startswith("__was_")]
            df = new.select(*[F.when(due, F.lit(v + 1) if c == version else F.col(c)).otherwise(F.col(f"__was_{c}") if c in was else None).alias(c) for c in kept])
        return df


def trade_schemas() -> SchemaRegistry:
    """Two changes of a trade's form: dollars in place of cents, then a currency."""
    out = SchemaRegistry()
    for v in (1, 2, 3):
        out.register("trade", v)
    out.upcaster("trade", 1, lambda d: d.withColumn("profit", F.col("profit") / 100))
    out.upcaster("trade", 2, lambda d: d.withColumn("currency", F.coalesce("currency", F.lit("USD"))))
    return out


@query(SQL + "SELECT seq, CAST(3 AS INT) AS version, round(CASE k % 3 WHEN 0 THEN pnl_c / CAST(100 AS DOUBLE) ELSE pnl_c END, 4) AS profit, CASE WHEN k % 3 < 2 THEN 'USD' ELSE 'JPY' END AS currency FROM trades")
def upcast_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of three versions, all brought to the latest."""
    old = trades(spark, sf_dir).select("seq", (F.col("k") % 3 + 1).cast("int").alias("version"), F.col("pnl_c").cast("double").alias("profit"), F.when(F.col("k") % 3 == 2, "JPY").alias("currency"))
    return trade_schemas().upcast(old, "trade").withColumn("profit", F.round("profit", 4))


@query(SQL + "SELECT symbol AS event_type, string_agg(DISTINCT CAST(seq % 4 + 1 AS VARCHAR), ',' ORDER BY CAST(seq % 4 + 1 AS VARCHAR)) AS versions, max(seq % 4 + 1) AS latest FROM ticks GROUP BY symbol")
def schema_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that occur of each event type, in order, and the latest."""
    v = F.col("seq") % 4 + 1
    return ticks(spark, sf_dir).groupBy(F.col("symbol").alias("event_type")).agg(F.array_join(F.sort_array(F.collect_set(v.cast("string"))), ",").alias("versions"), F.max(v).alias("latest"))


#: Reasons to skip and the numbers of their codes.
SKIP_CODES = {
    "staleness_rejected": 1, "risk_limit_rejected": 2, "daily_realized_halt": 2, "weekly_halt": 2, "monthly_halt": 2, "gap_detected": 3, "unknown_regime": 4, "strategy_culled": 5, "kill_switch_masked": 5,
    "hold_degeneration": 6, "mtm_q_threshold_rejected": 7, "trigger conditions not met": 7, "global_position_rejected": 8, "already_in_position": 8, "zero_effective_lot": 1,
}


def skip_code(reason: Column) -> Column:
    """The code of a reason, 0 for any other; null where nothing was skipped."""
    out = F.when(reason.isNull(), None)
    for name, code in SKIP_CODES.items():
        out = out.when(reason == name, code)
    return out.otherwise(0).cast("int")


@query(SQL + "SELECT seq, strategy, CASE WHEN skip_reason IS NULL THEN NULL " + " ".join(f"WHEN skip_reason = '{r}' THEN {c}" for r, c in SKIP_CODES.items()) + " ELSE 0 END AS skip_code, CASE WHEN direction = 'Buy' THEN 1 WHEN direction = 'Sell' THEN 2 ELSE 0 END AS action FROM decisions")
def decision_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions as events: codes in place of names."""
    return decisions(spark, sf_dir).select("seq", "strategy", skip_code(F.col("skip_reason")).alias("skip_code"), F.when(F.col("direction") == "Buy", 1).when(F.col("direction") == "Sell", 2).otherwise(0).alias("action"))


@query(SQL + """, v AS (SELECT strategy, seq, row_number() OVER (PARTITION BY strategy ORDER BY seq) AS version, coalesce(close_reason = 'MAX_HOLD_TIME', false) AS forced FROM trades) SELECT strategy, seq, version, forced FROM v WHERE version % 100 = 0 OR forced""")
def state_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of the state that are written: every hundredth, and forced ones."""
    forced = F.coalesce(F.col("close_reason") == "MAX_HOLD_TIME", F.lit(False))
    return numbered(trades(spark, sf_dir), ["strategy"]).select("strategy", "seq", F.col("n").cast("bigint").alias("version"), forced.alias("forced")).where("version % 100 = 0 or forced")


@query(SQL + "SELECT i.seq, i.strategy, b.symbol, round(b.bid, 6) AS bid FROM trades i JOIN ticks b USING (seq) WHERE i.k >= 20 AND b.seq % 7 <> 0")
def index_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of an index with the bodies that are still there; entries whose body has gone drop out."""
    return trades(spark, sf_dir).where("k >= 20").select("seq", "strategy").join(ticks(spark, sf_dir).where("seq % 7 <> 0").select("seq", "symbol", F.round("bid", 6).alias("bid")), "seq").select("seq", "strategy", "symbol", "bid")


@query(SQL + "SELECT seq % 3 AS batch, strategy, count(*) AS n, CAST(sum(pnl_c) AS BIGINT) AS pnl_c FROM trades GROUP BY ALL")
def batch_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of batches put together by name."""
    t = trades(spark, sf_dir)
    parts = [t.where(F.col("seq") % 3 == b).groupBy("strategy").agg(F.sum("pnl_c").alias("pnl_c"), F.count("*").alias("n")).select(F.lit(b).cast("bigint").alias("batch"), *(("strategy", "n", "pnl_c") if b else ("pnl_c", "n", "strategy"))) for b in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("batch", "strategy", "n", "pnl_c")


@query(SQL + "SELECT seq, strategy, row_number() OVER (PARTITION BY ts_ns // 60000000000 ORDER BY q_sampled DESC, strategy, seq) AS priority FROM decisions WHERE triggered")
def decision_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order in which the decisions of a minute are carried out: by sampled value, then by strategy."""
    w = Window.partitionBy(F.expr("ts_ns div 60000000000")).orderBy(F.desc("q_sampled"), "strategy", "seq")
    return decisions(spark, sf_dir).where("triggered").select("seq", "strategy", F.row_number().over(w).cast("bigint").alias("priority"))


@query(SQL + """, t AS (SELECT strategy, seq, avg(CASE WHEN triggered AND direction IS NOT NULL AND skip_reason IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END) OVER (PARTITION BY strategy ORDER BY seq ROWS 499 PRECEDING) AS frequency FROM decisions) SELECT strategy, seq, round(frequency, 8) AS frequency FROM t""")
def trade_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the last 500 decisions that led to a trade."""
    traded = (F.col("triggered") & F.col("direction").isNotNull() & F.col("skip_reason").isNull()).cast("double")
    x = haloed(numbered(decisions(spark, sf_dir).select("strategy", "seq", traded.alias("traded")), ["strategy"]))
    x = frame_sums(x, Window.partitionBy("strategy", "chunk").orderBy("n"), "traded", (500,))
    return x.where("own").select("strategy", "seq", F.round("traded_mean_500", 8).alias("frequency"))


def dynamic_k(base: float, volatility: Column, stability: Column) -> Column:
    """Penalty of uncertainty: grows with volatility, and in an unstable regime."""
    return F.lit(base) * (1 + 10 * volatility) * F.when(stability < 0.5, 1 + 2 * (1 - stability)).otherwise(1.0)


@query(FEATURES + "SELECT f.symbol, f.seq, round(1.5 * (1 + 10 * rv) * CASE WHEN k / CAST(100 AS DOUBLE) < 0.5 THEN 1 + 2 * (1 - k / CAST(100 AS DOUBLE)) ELSE 1 END, 6) AS k FROM f JOIN trades t ON t.seq = f.seq")
def uncertainty_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = features(ticks(spark, sf_dir)).select("symbol", "seq", "rv").join(trades(spark, sf_dir).select("seq", (F.col("k") / 100.0).alias("stability")), "seq")
    return x.select("symbol", "seq", F.round(dynamic_k(1.5, F.col("rv"), F.col("stability")), 6).alias("k"))


@query(FEATURES + """, n AS (SELECT symbol, seq, obi, spread, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS n FROM f)
SELECT a.symbol, a.seq, round(sum(0.1 * pow(0.9, a.n - b.n) * b.obi), 7) AS drift_obi, round(sum(0.1 * pow(0.9, a.n - b.n) * b.spread), 9) AS drift_spread FROM n a JOIN n b ON a.symbol = b.symbol AND b.n BETWEEN a.n - 299 AND a.n GROUP BY a.symbol, a.seq""")
def regime_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of the features: each regime moves by a tenth toward them, and the posterior's weights of the regimes sum to one."""
    x = ticks(spark, sf_dir).select("symbol", "seq", ((F.col("ask_size") - F.col("bid_size")) / (F.col("ask_size") + F.col("bid_size"))).alias("obi"), (F.col("ask") - F.col("bid")).alias("spread"))
    e = ema(numbered(x, ["symbol"]), ["symbol"], {"drift_obi": ("obi", 0.0), "drift_spread": ("spread", 0.0)}, 0.1)
    return e.select("symbol", "seq", F.round("drift_obi", 7).alias("drift_obi"), F.round("drift_spread", 9).alias("drift_spread"))


#: Stored weights of a linear regime model: a row for each regime over |z|, 100 x volatility, volatility ratio; and its constants.
WEIGHTS, BIAS = ((-1.2, -0.8, -0.5), (0.1, -0.2, 0.4), (0.6, 0.5, 0.3), (0.9, 0.7, -0.2)), (1.0, 0.3, -0.4, -1.5)


def linear_posterior(x: Column, weights: tuple, bias: tuple) -> Column:
    """softmax(W x + b) of an array, stabilised; null where its length is not that of the weights."""
    scores = F.array(*[sum((F.element_at(x, i + 1) * w for i, w in enumerate(row)), F.lit(b)) for row, b in zip(weights, bias, strict=True)])
    raised = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(raised, F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(x) == len(weights[0]), F.transform(raised, lambda e: e / total))


_SCORE = [f"exp({b} + " + " + ".join(f"({w}) * {c}" for w, c in zip(row, ("abs(spread_z)", "100 * rv", "volatility_ratio"), strict=True)) + ")" for row, b in zip(WEIGHTS, BIAS, strict=True)]


@query(FEATURES + f", e AS (SELECT symbol, seq, {', '.join(f'{s} AS e{i}' for i, s in enumerate(_SCORE))} FROM f) SELECT symbol, seq, " + ", ".join(f"round(e{i} / (e0 + e1 + e2 + e3), 5) AS p{i}" for i in range(4)) + " FROM e")
def linear_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior by stored weights."""
    x = features(ticks(spark, sf_dir)).select("symbol", "seq", F.array(F.abs("spread_z"), 100 * F.col("rv"), F.col("volatility_ratio")).alias("x"))
    x = x.select("symbol", "seq", linear_posterior(F.col("x"), WEIGHTS, BIAS).alias("p"))
    return x.select("symbol", "seq", *[F.round(F.col("p")[i], 5).alias(f"p{i}") for i in range(4)])


@query(SQL + """, s AS (SELECT lp_id, avg(slippage) AS mean FROM trades GROUP BY lp_id) SELECT t.seq, t.lp_id, round(k / CAST(100 AS DOUBLE) * (CAST(1e-4 AS DOUBLE) + 0.01 + 0.001) - CASE WHEN direction = 'Sell' THEN CAST(5e-5 AS DOUBLE) ELSE 0 END + mean, 9) AS expected FROM trades t JOIN s USING (lp_id)""")
def lp_slippage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected slippage of each trade with what its provider has shown; providers are few, so Spark broadcasts their means by its own check."""
    from .execution import expected_slippage

    t = trades(spark, sf_dir)
    s = t.groupBy("lp_id").agg(F.avg("slippage").alias("mean"))
    return t.join(s, "lp_id").select("seq", "lp_id", F.round(expected_slippage(F.col("k") / 100.0, F.col("lots") / 100000.0, F.col("direction") == "Sell", F.col("mean")), 9).alias("expected"))


#: Fixed values of the provider monitor: weight of the means and where they start, least requests, bounds of the fill rate, rejections in a row.
LP_ALPHA, LP_FILL, LP_REJECT, LP_LEAST, LP_BAD, LP_GOOD, LP_RUN = 0.1, 0.8, 0.2, 20, 0.5, 0.8, 5


def provider_states(t: DataFrame) -> DataFrame:
    """Each request with its provider's means after it, and whether the provider is adversarial: it becomes so by a low fill rate or rejections in a row, and recovers."""
    x = numbered(t.select("lp_id", "seq", "slippage", (F.col("k") < 90).cast("double").alias("fill"), (F.col("k") >= 90).cast("double").alias("reject")), ["lp_id"])
    x = ema(x, ["lp_id"], {"fill_ema": ("fill", LP_FILL), "reject_ema": ("reject", LP_REJECT)}, LP_ALPHA)
    h = haloed(x, halo=LP_RUN)
    h = h.withColumn("run", F.sum("reject").over(Window.partitionBy("lp_id", "chunk").orderBy("n").rowsBetween(1 - LP_RUN, 0))).where("own").drop("chunk", "own")
    bad = (F.col("n") >= LP_LEAST) & ((F.round("fill_ema", 9) < LP_BAD) | (F.col("run") >= LP_RUN))
    h = h.withColumn("mark", F.when(bad, True).when(F.round("fill_ema", 9) >= LP_GOOD, False))
    return carried_last(h, ["lp_id"], "mark", "adversarial").withColumn("adversarial", F.coalesce("adversarial", F.lit(False)))


PROVIDERS = SQL + """, r0 AS (SELECT lp_id, seq, slippage, CASE WHEN k < 90 THEN CAST(1 AS DOUBLE) ELSE 0 END AS fill, row_number() OVER (PARTITION BY lp_id ORDER BY seq) AS n FROM trades),
r1 AS (SELECT a.lp_id, a.seq, a.n, any_value(a.fill) AS fill, 0.8 * pow(0.9, a.n) + sum(0.1 * pow(0.9, a.n - b.n) * b.fill) AS fill_ema, 0.2 * pow(0.9, a.n) + sum(0.1 * pow(0.9, a.n - b.n) * (1 - b.fill)) AS reject_ema FROM r0 a JOIN r0 b ON a.lp_id = b.lp_id AND b.n BETWEEN a.n - 299 AND a.n GROUP BY a.lp_id, a.seq, a.n),
r2 AS (SELECT *, sum(1 - fill) OVER (PARTITION BY lp_id ORDER BY n ROWS 4 PRECEDING) AS run FROM r1), r3 AS (SELECT *, CASE WHEN n >= 20 AND (round(fill_ema, 9) < 0.5 OR run >= 5) THEN true WHEN round(fill_ema, 9) >= 0.8 THEN false END AS mark FROM r2),
ps AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY lp_id ORDER BY n ROWS UNBOUNDED PRECEDING), false) AS adversarial FROM r3)
"""


@query(PROVIDERS + "SELECT lp_id, seq, round(fill_ema, 7) AS fill_ema, adversarial FROM ps")
def lp_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provider_states(trades(spark, sf_dir)).select("lp_id", "seq", F.round("fill_ema", 7).alias("fill_ema"), "adversarial")


@query(PROVIDERS + """, e AS (SELECT lp_id, arg_max(fill_ema, n) AS f, arg_max(reject_ema, n) AS r, arg_max(adversarial, n) AS a FROM ps GROUP BY lp_id), h AS (SELECT lp_id, sqrt(var_pop(slippage)) AS sigma FROM trades GROUP BY lp_id)
SELECT lp_id, round(CASE WHEN a THEN 1 ELSE least(1, greatest(0, r, 1 - f)) END, 7) AS adversarial_score, round(sigma, 9) AS hidden_sigma FROM e JOIN h USING (lp_id)""")
def lp_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How adversarial a provider is now, and the spread of its slippage that nothing explains."""
    e = provider_states(trades(spark, sf_dir)).groupBy("lp_id").agg(*[F.max_by(c, "n").alias(c) for c in ("fill_ema", "reject_ema", "adversarial")], F.sqrt(F.greatest(F.var_pop("slippage"), F.lit(0.0))).alias("sigma"))
    score = F.when(F.col("adversarial"), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("reject_ema"), 1 - F.col("fill_ema"))))
    return e.select("lp_id", F.round(score, 7).alias("adversarial_score"), F.round("sigma", 9).alias("hidden_sigma"))


#: Warning and critical thresholds of the metrics of health; bad values in a row that an alert needs.
HEALTH = (
    ("q_value_adjustment_frequency", 0.8, 0.95), ("bayesian_posterior_drift", 2.0, 5.0), ("feature_distribution_kl_divergence", 0.5, 1.0), ("last_look_rejection_rate", 0.3, 0.5), ("lp_adversarial_score", 0.5, 0.8),
    ("dynamic_cost_estimate_error", 0.5, 1.0), ("rolling_variance_latency", 5.0, 20.0), ("latency_risk_trend", 2.0, 5.0), ("policy_entropy", 2.0, 2.5), ("regime_posterior_entropy", 1.5, 1.8), ("liquidity_evolvement", 3.0, 5.0),
    ("hidden_liquidity_sigma", 0.1, 0.2), ("self_impact_ratio", 0.5, 0.8), ("daily_pnl_vs_limit", 0.6, 0.8), ("weekly_pnl_vs_limit", 0.6, 0.8), ("monthly_pnl_vs_limit", 0.6, 0.8), ("position_constraint_saturation_rate", 0.7, 0.9),
)
DEBOUNCE, FRAME, POSITION_LIMIT = 3, 256, 10.0
METRICS = ("daily_pnl_vs_limit", "weekly_pnl_vs_limit", "monthly_pnl_vs_limit", "last_look_rejection_rate", "position_constraint_saturation_rate", "execution_drift_trend")


def pre_failure(t: DataFrame) -> DataFrame:
    """Metrics that tell trouble early, after each trade of a strategy: profit against limits, rejections and drift of the last 256, use of the position limit."""
    x = numbered(period_profit(t), ["strategy"])
    x = running(x, ["strategy"], {"position": F.when(F.col("direction") == "Buy", F.col("lots")).otherwise(-F.col("lots"))})
    x = haloed(x.withColumns({"rejected": (F.col("k") >= 90).cast("double")}))
    w = Window.partitionBy("strategy", "chunk").orderBy("n")
    x = frame_sums(frame_sums(x, w, "rejected", (FRAME,)), w, "slippage", (FRAME,)).where("own")
    return x.withColumns({
        "daily_pnl_vs_limit": F.col("day_pnl_c") / abs(DAILY_C), "weekly_pnl_vs_limit": F.col("week_pnl_c") / abs(WEEKLY_C), "monthly_pnl_vs_limit": F.col("month_pnl_c") / abs(MONTHLY_C),
        "last_look_rejection_rate": F.col(f"rejected_mean_{FRAME}"), "position_constraint_saturation_rate": F.abs("position") / 100000.0 / POSITION_LIMIT, "execution_drift_trend": F.col(f"slippage_mean_{FRAME}"),
    })


PRE_FAILURE = PERIODS + f""", pf AS (SELECT strategy, seq, ts_ns, day_pnl_c / CAST({abs(DAILY_C)} AS DOUBLE) AS daily_pnl_vs_limit, week_pnl_c / CAST({abs(WEEKLY_C)} AS DOUBLE) AS weekly_pnl_vs_limit, month_pnl_c / CAST({abs(MONTHLY_C)} AS DOUBLE) AS monthly_pnl_vs_limit,
 avg(CASE WHEN k >= 90 THEN CAST(1 AS DOUBLE) ELSE 0 END) OVER w AS last_look_rejection_rate, abs(sum(CASE WHEN direction = 'Buy' THEN lots ELSE -lots END) OVER (PARTITION BY strategy ORDER BY seq ROWS UNBOUNDED PRECEDING)) / CAST(1000000 AS DOUBLE) AS position_constraint_saturation_rate, avg(slippage) OVER w AS execution_drift_trend
 FROM pp WINDOW w AS (PARTITION BY strategy ORDER BY seq ROWS 255 PRECEDING))
"""


@query(PRE_FAILURE + "SELECT strategy, seq, " + ", ".join(f"{settled_sql(m, 8)} AS {m}" for m in METRICS) + " FROM pf")
def pre_failure_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pre_failure(trades(spark, sf_dir)).select("strategy", "seq", *[settled(F.col(m), 8).alias(m) for m in METRICS])


@query(PRE_FAILURE + f""", l AS (SELECT strategy, seq, unnest([{", ".join(f"'{m}'" for m in METRICS)}]) AS metric, unnest([{", ".join(f"abs({m})" for m in METRICS)}]) AS v FROM pf), th AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {w}, {c})" for m, w, c in HEALTH)}) AS t(metric, warn, crit)),
b AS (SELECT l.*, round(v, 9) >= warn AS bad, round(v, 9) >= crit AS worst FROM l JOIN th USING (metric)), r AS (SELECT *, sum(CAST(bad AS INT)) OVER (PARTITION BY strategy, metric ORDER BY seq ROWS 2 PRECEDING) AS run FROM b)
SELECT strategy, metric, count(*) FILTER (worst) AS critical, count(*) FILTER (NOT worst) AS warning FROM r WHERE run >= 3 GROUP BY ALL""")
def health_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of health against their thresholds, those without one left out; an alert needs three bad values in a row."""
    known = spark.createDataFrame(list(HEALTH), "metric string, warn double, crit double")
    x = pre_failure(trades(spark, sf_dir)).select("strategy", "n", *[F.abs(m).alias(m) for m in METRICS]).unpivot(["strategy", "n"], list(METRICS), "metric", "v").join(F.broadcast(known), "metric")
    x = x.withColumns({"bad": F.round("v", 9) >= F.col("warn"), "worst": F.round("v", 9) >= F.col("crit")})
    h = haloed(x, halo=DEBOUNCE)
    h = h.withColumn("run", F.sum(F.col("bad").cast("int")).over(Window.partitionBy("strategy", "metric", "chunk").orderBy("n").rowsBetween(1 - DEBOUNCE, 0))).where("own and run >= 3")
    return h.groupBy("strategy", "metric").agg(F.count_if("worst").alias("critical"), F.count_if(~F.col("worst")).alias("warning"))


#: Share of a limit, deviations of drift, relative loss of Sharpe that raise an alert; time in which one type is raised once.
RISK_SHARE, DRIFT_Z, SHARPE_LOSS, QUIET_NS = 0.8, 0.5, 0.5, 3_600_000_000_000


def alerts(t: DataFrame, risk: float = RISK_SHARE, drift: float = DRIFT_Z) -> DataFrame:
    """Alerts that trades give reason to, before any is held back: strategy, seq, ts_ns, type, severity."""
    x = pre_failure(t).withColumn("sd", F.sqrt(F.col(f"slippage_m2_{FRAME}") / F.col(f"slippage_count_{FRAME}")))
    loss = F.round(-F.col("daily_pnl_vs_limit"), 9)
    z = F.round(F.when(F.col("sd") > 1e-12, F.abs("execution_drift_trend") / F.col("sd")).otherwise(0.0), 6)
    some = F.array(
        F.when(loss >= risk, F.struct(F.lit("RiskLimit").alias("type"), F.when(loss >= 1, "Critical").otherwise("Warning").alias("severity"))),
        F.when(z >= drift, F.struct(F.lit("ExecutionDrift").alias("type"), F.lit("Warning").alias("severity"))),
        F.when(F.col("close_reason") == "MAX_HOLD_TIME", F.struct(F.lit("KillSwitch").alias("type"), F.lit("Critical").alias("severity"))),
    )
    return x.select("strategy", "seq", "ts_ns", F.explode(F.array_compact(some)).alias("a")).select("strategy", "seq", "ts_ns", "a.*")


def sharpe_degradation(current: Column, baseline: Column, most: float = SHARPE_LOSS) -> Column:
    """Whether a Sharpe ratio has lost at least so much of a positive baseline."""
    return F.coalesce((baseline > 2.220446049250313e-16) & ((baseline - current) / baseline >= most), F.lit(False))


def quiet(quiet_ns: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Of rows sorted by strategy, type and time those that come long enough after the last one kept; only that one's time is held."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, 0
        for part in parts:
            keep = []
            for k, t in zip(zip(part["strategy"], part["type"], strict=True), part["ts_ns"], strict=True):
                keep.append(k != key or t - last >= quiet_ns)
                if keep[-1]:
                    key, last = k, t
            yield part[keep]

    return run


ALERTS = PRE_FAILURE + f""", z AS (SELECT pf.*, t.close_reason, stddev_pop(slippage) OVER (PARTITION BY strategy ORDER BY seq ROWS 255 PRECEDING) AS sd FROM pf JOIN (SELECT seq, slippage, close_reason FROM trades) t USING (seq)),
al AS (SELECT strategy, seq, ts_ns, 'RiskLimit' AS type, CASE WHEN round(-daily_pnl_vs_limit, 9) >= 1 THEN 'Critical' ELSE 'Warning' END AS severity FROM z WHERE round(-daily_pnl_vs_limit, 9) >= {RISK_SHARE}
 UNION ALL SELECT strategy, seq, ts_ns, 'ExecutionDrift', 'Warning' FROM z WHERE sd > 1e-12 AND round(abs(execution_drift_trend) / sd, 6) >= {DRIFT_Z} UNION ALL SELECT strategy, seq, ts_ns, 'KillSwitch', 'Critical' FROM z WHERE close_reason = 'MAX_HOLD_TIME')
"""


@query(ALERTS + "SELECT strategy, seq, type, severity FROM al")
def alert_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts(trades(spark, sf_dir)).select("strategy", "seq", "type", "severity")


@query(ALERTS.replace("WITH base", "WITH RECURSIVE base", 1) + f""", kept AS (SELECT strategy, type, min(ts_ns) AS ts_ns FROM al GROUP BY ALL UNION ALL SELECT k.strategy, k.type, (SELECT min(a.ts_ns) FROM al a WHERE a.strategy = k.strategy AND a.type = k.type AND a.ts_ns >= k.ts_ns + {QUIET_NS}) FROM kept k WHERE k.ts_ns IS NOT NULL)
SELECT a.strategy, a.seq, a.type, a.severity FROM al a JOIN kept k ON a.strategy = k.strategy AND a.type = k.type AND a.ts_ns = k.ts_ns""")
def alerts_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of which each type of a strategy is sent once in an hour."""
    a = alerts(trades(spark, sf_dir)).repartition("strategy", "type").sortWithinPartitions("strategy", "type", "ts_ns", "seq")
    return a.mapInPandas(quiet(QUIET_NS), a.schema).select("strategy", "seq", "type", "severity")


@query(PERIODS + f""", h AS (SELECT *, day_pnl_c < {DAILY_C} AS over FROM pp), f AS (SELECT *, over AND sum(CAST(over AS INT)) OVER (PARTITION BY strategy, day ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) = 1 AS halt, seq = max(seq) OVER (PARTITION BY strategy) AS last FROM h),
c AS (SELECT *, sum(CAST(halt OR last AS INT)) OVER (PARTITION BY strategy ORDER BY seq ROWS UNBOUNDED PRECEDING) - CAST(halt OR last AS INT) AS part FROM f),
g AS (SELECT strategy, part, CAST(sum(CASE WHEN direction = 'Buy' THEN lots ELSE -lots END) AS BIGINT) AS position, max(seq) AS seq, arg_max(CASE WHEN halt THEN 'daily_realized_halt' ELSE 'end_of_data' END, seq) AS reason FROM c GROUP BY ALL)
SELECT strategy, seq, CASE WHEN position > 0 THEN 'Sell' ELSE 'Buy' END AS direction, abs(position) AS lots, reason FROM g WHERE position <> 0""")
def forced_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that close all: when a day's limit is first passed, and at the end of the data; against the position since the close before."""
    x = period_profit(trades(spark, sf_dir)).withColumn("over", F.col("day_pnl_c") < DAILY_C)
    first = x.where("over").groupBy("strategy", "day").agg(F.min("seq").alias("halt_seq")).select("strategy", F.col("halt_seq").alias("seq"), F.lit("daily_realized_halt").alias("reason"))
    last = x.groupBy("strategy").agg(F.max("seq").alias("seq")).withColumn("reason", F.lit("end_of_data"))
    closes = first.unionByName(last).groupBy("strategy", "seq").agg(F.min("reason").alias("reason"))
    n = numbered(x.join(closes, ["strategy", "seq"], "left"), ["strategy"])
    n = running(n, ["strategy"], {"closed": F.col("reason").isNotNull().cast("bigint"), "position": F.when(F.col("direction") == "Buy", F.col("lots")).otherwise(-F.col("lots"))})
    ends = n.where("reason is not null").select("strategy", "seq", "reason", "closed", "position")
    before = ends.select("strategy", (F.col("closed") + 1).alias("closed"), F.col("position").alias("was"))
    own = ends.join(before, ["strategy", "closed"], "left").withColumn("position", F.col("position") - F.coalesce("was", F.lit(0))).where("position <> 0")
    return own.select("strategy", "seq", F.when(F.col("position") > 0, "Sell").otherwise("Buy").alias("direction"), F.abs("position").cast("bigint").alias("lots"), "reason")


@query(SQL + """SELECT seq, CAST(sum(CASE WHEN direction = 'Buy' THEN lots ELSE -lots END) OVER w AS BIGINT) AS position, CAST(sum(pnl_c) OVER w AS BIGINT) AS realized_c, round(sum(CASE WHEN direction = 'Buy' THEN lots ELSE -lots END) OVER w * (t.bid + t.ask - 200) / 2, 2) AS unrealized FROM trades JOIN ticks t USING (seq) WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def position_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, realised and unrealised profit over all strategies after each fill."""
    x = numbered(trades(spark, sf_dir), [])
    x = running(x, [], {"position": F.when(F.col("direction") == "Buy", F.col("lots")).otherwise(-F.col("lots")), "realized_c": F.col("pnl_c")})
    x = x.join(ticks(spark, sf_dir).select("seq", "bid", "ask"), "seq")
    return x.select("seq", "position", "realized_c", F.round(F.col("position") * (F.col("bid") + F.col("ask") - 200) / 2, 2).alias("unrealized"))


@query(SQL + """, r AS (SELECT strategy, skip_reason, count(*) AS n FROM decisions WHERE skip_reason IS NOT NULL GROUP BY ALL), c AS (SELECT strategy, close_reason, count(*) AS n FROM decisions WHERE close_reason IS NOT NULL AND skip_reason IS NULL GROUP BY ALL)
SELECT strategy, count(*) FILTER (triggered) AS n_triggered, count(*) FILTER (triggered AND direction IS NOT NULL) AS attempted, count(*) FILTER (triggered AND direction IS NOT NULL AND skip_reason IS NULL) AS filled,
 coalesce((SELECT string_agg(skip_reason || '=' || n, ';' ORDER BY skip_reason) FROM r WHERE r.strategy = d.strategy), '') AS skips, coalesce((SELECT string_agg(close_reason || '=' || n, ';' ORDER BY close_reason) FROM c WHERE c.strategy = d.strategy), '') AS closes FROM decisions d GROUP BY strategy""")
def forward_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by stage, with maps of the reasons to skip and to close; the reasons are a fixed, short list."""
    d = decisions(spark, sf_dir)
    listed = lambda x, c, name: x.groupBy("strategy", c).agg(F.count("*").alias("n")).groupBy("strategy").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "n")))).alias(name))
    text = lambda c: F.coalesce(F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";"), F.lit(""))
    go = F.col("triggered") & F.col("direction").isNotNull()
    n = d.groupBy("strategy").agg(F.count_if("triggered").alias("n_triggered"), F.count_if(go).alias("attempted"), F.count_if(go & F.col("skip_reason").isNull()).alias("filled"))
    n = n.join(listed(d.where("skip_reason is not null"), "skip_reason", "skips"), "strategy", "left").join(listed(d.where("close_reason is not null and skip_reason is null"), "close_reason", "closes"), "strategy", "left")
    return n.withColumns({"skips": text("skips"), "closes": text("closes")})


@query(SQL + "SELECT symbol, count(*) AS n, round(min(bid_size / 100000), 6) AS least_ms, round(max(bid_size / 100000), 6) AS most_ms, round(avg(bid_size / 100000), 6) AS mean_ms FROM ticks GROUP BY symbol")
def gateway_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency of published quotes by symbol."""
    ms = F.col("bid_size") / 100000
    return ticks(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.min(ms), 6).alias("least_ms"), F.round(F.max(ms), 6).alias("most_ms"), F.round(F.avg(ms), 6).alias("mean_ms"))


@query("SELECT range AS attempt, least(100 * CAST(pow(2, least(range, 10)) AS BIGINT), 30000) AS wait_ms FROM range(0, 16)")
def reconnect_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits before attempts to reconnect: doubled ten times at most, and never beyond a bound."""
    return spark.range(16).select(F.col("id").alias("attempt"), F.least(100 * F.pow(F.lit(2), F.least("id", F.lit(10))).cast("bigint"), F.lit(30000)).alias("wait_ms"))


#: Pull of the synthetic price toward its base; rows of a block, long enough for that pull.
PULL, LONG_BLOCK = 0.001, 16_384


def synthetic_ticks(spark: SparkSession, rows: int, seed: str = "walk", start_ns: int = 1_700_000_000_000_000_000, interval_ms: int = 100, base: float = 150.0, volatility: float = 0.005) -> DataFrame:
    """A seeded walk that reverts to its base: seq (from 1), ts_ns, bid, ask, sizes. Noise is a hash of seed and number, so any partitioning gives the same."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col("n").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    x = spark.range(1, rows + 1).select(F.col("id").alias("n")).withColumn("noise", (2 * u - 1) * volatility * (1 - PULL) / PULL)
    x = ema(x, [], {"off": ("noise", 0.0)}, PULL, LONG_BLOCK)
    return x.select(F.col("n").alias("seq"), (F.lit(start_ns) + (F.col("n") - 1) * (interval_ms * 1_000_000)).alias("ts_ns"), (base + F.col("off") - 0.005).alias("bid"), (base + F.col("off") + 0.005).alias("ask"), F.lit(1e6).alias("bid_size"), F.lit(1e6).alias("ask_size"))


@query("""WITH u AS (SELECT range AS n, (2 * (('0x' || substr(md5('walk:' || range), 1, 8))::BIGINT / CAST(4294967296 AS DOUBLE)) - 1) * 0.005 AS noise FROM range(1, 3001))
SELECT a.n AS seq, 1700000000000000000 + (a.n - 1) * 100000000 AS ts_ns, round(150 + sum(b.noise * pow(0.999, a.n - b.n + 1)) - 0.005, 7) AS bid, round(150 + sum(b.noise * pow(0.999, a.n - b.n + 1)) + 0.005, 7) AS ask FROM u a JOIN u b ON b.n <= a.n GROUP BY a.n""")
def synthetic_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic_ticks(spark, 3000).select("seq", "ts_ns", F.round("bid", 7).alias("bid"), F.round("ask", 7).alias("ask"))


#: Largest differences of a live run from its backtest.
APART = {"pnl": 0.2, "win_rate": 0.1, "sharpe": 0.3, "drawdown": 0.2, "fill_rate": 0.1, "slippage": 0.5}
RELATIVE = ("pnl", "drawdown")


@query(SQL + f""", q AS (SELECT strategy, seq % 2 AS half, pnl_c, k, slippage, sum(pnl_c) OVER (PARTITION BY strategy, seq % 2 ORDER BY seq ROWS UNBOUNDED PRECEDING) AS equity, seq FROM trades), d AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY strategy, half ORDER BY seq ROWS UNBOUNDED PRECEDING)) - equity AS down FROM q),
m AS (SELECT strategy, half, CAST(sum(pnl_c) AS DOUBLE) AS pnl, count(*) FILTER (pnl_c > 0) / count(*) AS win_rate, avg(pnl_c) / stddev_samp(pnl_c) AS sharpe, CAST(max(down) AS DOUBLE) AS drawdown, count(*) FILTER (k < 90) / count(*) AS fill_rate, avg(abs(slippage)) AS slippage FROM d GROUP BY ALL),
l AS (SELECT strategy, half, unnest([{", ".join(f"'{k}'" for k in APART)}]) AS metric, unnest([{", ".join(APART)}]) AS v FROM m), j AS (SELECT strategy, metric, b.v AS b, f.v AS f FROM (SELECT * FROM l WHERE half = 0) b FULL JOIN (SELECT * FROM l WHERE half = 1) f USING (strategy, metric)),
x AS (SELECT *, CASE WHEN metric IN ('pnl', 'drawdown') THEN CASE WHEN b = 0 AND f = 0 THEN 0 WHEN b = 0 THEN CAST('Infinity' AS DOUBLE) ELSE abs(f - b) / abs(b) END ELSE abs(f - b) END AS diff FROM j)
SELECT strategy, metric, round(b, 6) AS backtest, round(f, 6) AS forward, round(diff, 6) AS diff, round(diff, 9) <= CASE metric {" ".join(f"WHEN '{k}' THEN {v}" for k, v in APART.items())} END AS passed FROM x""")
def forward_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six metrics of two runs side by side, one of which may lack some: profit and drawdown by relative difference, the others by absolute."""
    t = trades(spark, sf_dir).withColumn("half", F.col("seq") % 2)
    by = ["strategy", "half"]
    e = running_max(running(numbered(t, by), by, {"equity": F.col("pnl_c")}), by, "equity", "peak")
    e = e.withColumn("down", F.greatest(F.lit(0), "peak") - F.col("equity"))
    p = F.col("pnl_c")
    m = e.groupBy(*by).agg(F.sum(p).cast("double").alias("pnl"), (F.count_if(p > 0) / F.count("*")).alias("win_rate"), (F.avg(p) / F.stddev_samp(p)).alias("sharpe"), F.max("down").cast("double").alias("drawdown"), (F.count_if(F.col("k") < 90) / F.count("*")).alias("fill_rate"), F.avg(F.abs("slippage")).alias("slippage"))
    long = m.unpivot(by, list(APART), "metric", "v")
    b, f = (long.where(F.col("half") == i).select("strategy", "metric", F.col("v").alias(c)) for i, c in ((0, "b"), (1, "f")))
    diff = F.abs(F.col("f") - F.col("b"))
    relative = F.when((F.col("b") == 0) & (F.col("f") == 0), 0.0).when(F.col("b") == 0, F.lit(float("inf"))).otherwise(diff / F.abs("b"))
    d = F.when(F.col("metric").isin(*RELATIVE), relative).otherwise(diff)
    most = F.element_at(F.create_map(*[F.lit(x) for kv in APART.items() for x in kv]), F.col("metric"))
    return b.join(f, ["strategy", "metric"], "full").select("strategy", "metric", F.round("b", 6).alias("backtest"), F.round("f", 6).alias("forward"), F.round(d, 6).alias("diff"), (F.round(d, 9) <= most).alias("passed"))


def decompose(backtest: float, forward: float, slippage: float, fill_rate: float, trades: int) -> dict[str, float]:
    """Parts of a difference in profit that execution, latency and impact explain, and what is left."""
    total = forward - backtest
    share = abs(total) / abs(backtest) if backtest else 0.0 if not forward else float("inf")
    execution, latency, impact = slippage * trades, share * backtest * 0.1, fill_rate * abs(total) * 0.05
    return {"execution": execution, "latency": latency, "impact": impact, "residual": total - execution - latency - impact}
