"""Results as files, and back: run results, session reports, trades, validation checks, feature dumps, scales, posteriors.

Tables are written by Spark; a summary of one row is a line of JSON. A folder
must be one that the driver and all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stored import scratch
from ..operators.stats import decision_diagnostics, strategy_funnel
from ..operators.vector import VECTOR, columns_for_model, load
from ..plans.registry import query
from .views import SQL, ticks, trades

FEATURE_VERSION, SOURCE_STRATEGY, NUM_FEATURES = "feature_vector_v1_38", "A", 45
METADATA = ("timestamp_ns", "source_strategy", "feature_version")
#: Features of a part of a row, which are aggregated together; decimals of a report's numbers.
PART = 10
DECIMALS = {"duration_secs": 3, "final_pnl": 6, "realized_pnl": 6, "unrealized_pnl": 6, "rolling_sharpe": 6, "max_drawdown": 6, "win_rate": 4}


def run_summary(t: DataFrame, quotes: DataFrame, features: int = len(VECTOR)) -> DataFrame:
    """One row about a run: counts, profit, rates."""
    p = F.col("pnl_c") / 100
    n = quotes.agg(F.count("*").alias("total_ticks"))
    s = t.agg(F.count("*").alias("total_trades"), F.count_if(F.col("close_reason").isNotNull()).alias("close_trades"), F.sum(p).alias("total_pnl"), F.avg((p > 0).cast("double")).alias("win_rate"), F.avg(F.abs("slippage")).alias("avg_slippage"), F.count_if(F.col("k") < 90).alias("total_fills"), F.count_if(F.col("k") >= 90).alias("total_rejections"))
    return s.crossJoin(n).withColumns({"overall_fill_rate": F.col("total_fills") / F.greatest(F.col("total_fills") + F.col("total_rejections"), F.lit(1)), "num_features": F.lit(features)})  # one row each


def write_run(spark: SparkSession, sf_dir: str, to: str) -> None:
    """A run's result: summary (JSON), trades (CSV), returns, breakdown, funnel and diagnostics (JSON lines), each as a table of its own."""
    t = trades(spark, sf_dir)
    run_summary(t, ticks(spark, sf_dir)).write.json(f"{to}/summary")
    rows = t.select(F.col("ts_ns").alias("timestamp_ns"), "strategy", "direction", "lots", "slippage", (F.col("pnl_c") / 100).alias("pnl"), "fill_probability", "latency_ms", "close_reason")
    rows.write.csv(f"{to}/trades", header=True)
    t.select("seq", (F.col("pnl_c") / 100).alias("ret")).write.json(f"{to}/returns")
    t.groupBy("strategy").agg(F.count("*").alias("total_trades"), (F.sum("pnl_c") / 100).alias("total_pnl")).write.json(f"{to}/strategy_breakdown")
    strategy_funnel(spark, sf_dir).write.json(f"{to}/strategy_funnel")
    decision_diagnostics(spark, sf_dir).write.json(f"{to}/decision_diagnostics")


TRADES = "timestamp_ns bigint, strategy string, direction string, lots bigint, slippage double, pnl double, fill_probability double, latency_ms double, close_reason string"


@query(SQL + """SELECT (SELECT count(*) FROM ticks) AS total_ticks, count(*) AS total_trades, count(close_reason) AS close_trades, round(sum(pnl_c) / CAST(100 AS DOUBLE), 4) AS total_pnl, round(avg(CASE WHEN pnl_c > 0 THEN 1.0 ELSE 0.0 END), 8) AS win_rate, count(*) AS csv_trades, round(sum(pnl_c) / CAST(100 AS DOUBLE), 4) AS csv_pnl, 3 AS strategies FROM trades""")
def run_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result written and read again."""
    to = scratch(spark, "run")
    write_run(spark, sf_dir, to)
    s = spark.read.schema("total_ticks bigint, total_trades bigint, close_trades bigint, total_pnl double, win_rate double").json(f"{to}/summary")
    c = spark.read.schema(TRADES).csv(f"{to}/trades", header=True).agg(F.count("*").alias("csv_trades"), F.round(F.sum("pnl"), 4).alias("csv_pnl"))
    b = spark.read.schema("strategy string").json(f"{to}/strategy_funnel").agg(F.count("*").cast("int").alias("strategies"))
    return s.withColumns({"total_pnl": F.round("total_pnl", 4), "win_rate": F.round("win_rate", 8)}).crossJoin(c).crossJoin(b)  # one row each


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session in rows (metric, value), numbers with fixed decimals."""
    t = trades(spark, sf_dir)
    s = run_summary(t, ticks(spark, sf_dir)).crossJoin(t.agg(((F.max("ts_ns") - F.min("ts_ns")) / 1e9).alias("duration_secs")))
    s = s.select("total_ticks", "total_trades", "duration_secs", F.col("total_pnl").alias("final_pnl"), F.col("total_pnl").alias("realized_pnl"), F.lit(0.0).alias("unrealized_pnl"), "win_rate")
    cells = [F.format_string(f"%.{DECIMALS[c]}f", F.col(c).cast("double")).alias(c) if c in DECIMALS else F.col(c).cast("string").alias(c) for c in s.columns]
    return s.select(*cells).unpivot([], s.columns, "metric", "value")


def write_report(spark: SparkSession, sf_dir: str, to: str) -> None:
    """Rows of a few metrics: one file."""
    report(spark, sf_dir).coalesce(1).write.csv(f"{to}/performance_summary", header=True)


@query(SQL + """, s AS (SELECT (SELECT count(*) FROM ticks) AS total_ticks, count(*) AS total_trades, (max(ts_ns) - min(ts_ns)) / CAST(1000000000 AS DOUBLE) AS duration_secs, sum(pnl_c) / CAST(100 AS DOUBLE) AS pnl, avg(CASE WHEN pnl_c > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS win_rate FROM trades)
SELECT unnest(['total_ticks', 'total_trades', 'duration_secs', 'final_pnl', 'realized_pnl', 'unrealized_pnl', 'win_rate']) AS metric, unnest([CAST(total_ticks AS VARCHAR), CAST(total_trades AS VARCHAR), printf('%.3f', duration_secs), printf('%.6f', pnl), printf('%.6f', pnl), '0.000000', printf('%.4f', win_rate)]) AS value FROM s""")
def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = scratch(spark, "report")
    write_report(spark, sf_dir, to)
    return spark.read.schema("metric string, value string").csv(f"{to}/performance_summary", header=True)


def read_returns(spark: SparkSession, path: str) -> DataFrame:
    """Returns of a result file (one JSON document): its list ``returns``, else the profits of its trades, else none. (obs from 1, ret)"""
    doc = spark.read.json(path, multiLine=True)
    have = {f.name: f.dataType.simpleString() for f in doc.schema.fields}
    if have.get("returns", "").startswith("array<") and "struct" not in have["returns"]:
        x = F.col("returns").cast("array<double>")
    elif "pnl" in have.get("trades", ""):
        x = F.filter(F.col("trades.pnl").cast("array<double>"), lambda v: v.isNotNull())
    else:
        x = F.array().cast("array<double>")
    return doc.select(F.posexplode(x).alias("obs", "ret")).select((F.col("obs") + 1).cast("bigint").alias("obs"), "ret")


def read_num_features(spark: SparkSession, path: str) -> int:
    doc = spark.read.json(path, multiLine=True)
    return int(doc.first()["num_features"]) if "num_features" in doc.columns else NUM_FEATURES


def write_checks(checks: DataFrame, to: str) -> None:
    """Checks (name, passed, details, value) as JSON lines; values that are not finite become 0."""
    v = F.col("value").cast("double")
    checks.withColumn("value", F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), 0.0).otherwise(v)).coalesce(1).write.json(to)


def read_checks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("strategy string, name string, passed boolean, value double").json(path)


def dump_features(x: DataFrame, to: str) -> None:
    """Vectors fit for a model as CSV: time, strategy, version, 38 columns."""
    v = x.select("ts_ns", columns_for_model().alias("v"))
    v.select(F.col("ts_ns").alias("timestamp_ns"), F.lit(SOURCE_STRATEGY).alias("source_strategy"), F.lit(FEATURE_VERSION).alias("feature_version"), *[F.col("v")[i].alias(n) for i, n in enumerate(VECTOR)]).write.csv(to, header=True)


def read_features(spark: SparkSession, path: str, version: str = FEATURE_VERSION) -> DataFrame:
    """A feature dump whose columns and version are exactly as expected; anything else is an error."""
    names = spark.read.csv(path, header=True).columns
    if tuple(names) != METADATA + VECTOR:
        raise ValueError(f"columns {names} are not those of a feature dump")
    out = spark.read.schema("timestamp_ns bigint, source_strategy string, feature_version string, " + ", ".join(f"{n} double" for n in VECTOR)).csv(path, header=True)
    found = [r[0] for r in out.select("feature_version").distinct().limit(2).collect()]
    if found != [version]:
        raise ValueError(f"feature versions {found} in place of {version!r}")
    return out


def fit_scales(x: DataFrame, least: float = 1.0) -> DataFrame:
    """(feature, mean, scale) of a feature dump; a scale is the population deviation, at least ``least``.

    A row's features go to one aggregate in parts of ``PART``: the state of all
    at once is more than Spark compiles. The mean of no values is null.
    """
    parts = [VECTOR[i : i + PART] for i in range(0, len(VECTOR), PART)]
    rows = [F.struct(F.lit(k).alias("part"), *[(F.col(p[i]).cast("double") if i < len(p) else F.lit(None).cast("double")).alias(f"f{i}") for i in range(PART)]) for k, p in enumerate(parts)]
    stats = x.select(F.inline(F.array(*rows))).groupBy("part").agg(*[F.struct(F.avg(f"f{i}").alias("mean"), F.stddev_pop(f"f{i}").alias("deviation")).alias(f"f{i}") for i in range(PART)])
    stats = stats.select("part", F.posexplode(F.array(*[f"f{i}" for i in range(PART)])).alias("at", "s")).select((F.col("part") * PART + F.col("at")).alias("place"), "s.*")
    names = x.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, VECTOR))).alias("place", "feature"))  # all, even of an empty dump
    return names.join(stats, "place", "left").select("feature", "mean", F.greatest("deviation", F.lit(least)).alias("scale"), F.lit(FEATURE_VERSION).alias("feature_version"))


def apply_scales(x: DataFrame, scales: DataFrame) -> DataFrame:
    """Features by the scales of a table of 38 rows; another version is an error."""
    rows = {r["feature"]: r for r in scales.collect()}
    if {r["feature_version"] for r in rows.values()} != {FEATURE_VERSION} or set(rows) != set(VECTOR):
        raise ValueError("scales of another feature version")
    return x.withColumns({n: (F.col(n) - F.lit(rows[n]["mean"])) / F.lit(rows[n]["scale"]) for n in VECTOR})


def _features_sql() -> str:
    from ..operators.vector import VECTOR_SQL

    return VECTOR_SQL + """, s AS (SELECT avg(pnl_unrealized) AS mu, greatest(stddev_pop(pnl_unrealized), 1.0) AS sp, avg(spread) AS ms, greatest(stddev_pop(spread), 1.0) AS ss FROM v)
SELECT t.ts_ns AS timestamp_ns, round((pnl_unrealized - mu) / sp, 6) AS pnl_unrealized, round((spread - ms) / ss, 8) AS spread FROM v JOIN (SELECT seq, ts_ns FROM ticks) t USING (seq), s"""


@query(_features_sql())
def feature_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features dumped, read with their checks, scales fitted, written, read and applied."""
    to = scratch(spark, "features")
    dump_features(load(spark, sf_dir), to)
    x = read_features(spark, to)
    fit_scales(x).coalesce(1).write.json(f"{to}-scales")
    scales = spark.read.schema("feature string, mean double, scale double, feature_version string").json(f"{to}-scales")
    return apply_scales(x, scales).select("timestamp_ns", F.round("pnl_unrealized", 6).alias("pnl_unrealized"), F.round("spread", 8).alias("spread"))


POSTERIOR = "schema_version int, feature_version string, strategy string, action string, dim int, mean array<double>, precision array<double>, updates bigint"


def write_posteriors(p: DataFrame, to: str) -> None:
    """Posteriors of all strategies and actions; values that are not finite become 0, precisions are at least 1e-10."""
    sane = lambda c: F.transform(c, lambda x: F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))) | x.isNull(), 0.0).otherwise(x))
    p.withColumns({"mean": sane("mean"), "precision": F.transform(sane("precision"), lambda x: F.greatest(x, F.lit(1e-10)))}).write.parquet(to)


def read_posteriors(spark: SparkSession, path: str, feature_version: str = FEATURE_VERSION) -> DataFrame:
    """Posteriors whose versions, strategies, actions and dimensions are complete and agree; anything else is an error."""
    p = spark.read.schema(POSTERIOR).parquet(path)
    bad = p.where((F.col("schema_version") != 1) | (F.col("feature_version") != feature_version) | (F.size("mean") != F.col("dim")) | (F.size("precision") != F.col("dim"))).limit(1).count()
    keys = p.groupBy("strategy").agg(F.count("*").alias("n"), F.count_distinct("action").alias("actions")).limit(4).collect()
    if bad or len(keys) != 3 or any((r["n"], r["actions"]) != (3, 3) for r in keys):
        raise ValueError("not a complete snapshot of posteriors")
    return p


@query(SQL + """, a AS (SELECT strategy, unnest(['Buy', 'Sell', 'Hold']) AS action FROM (SELECT DISTINCT strategy FROM trades)), g AS (SELECT strategy, direction AS action, avg(pnl_c) AS m, count(*) AS n FROM trades GROUP BY ALL)
SELECT a.strategy, a.action, round(coalesce(m, 0), 6) AS mean, CAST(coalesce(n, 0) AS DOUBLE) AS precision FROM a LEFT JOIN g USING (strategy, action)""")
def posterior_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A posterior for each strategy and action, written and read with its checks."""
    g = trades(spark, sf_dir).groupBy("strategy", F.col("direction").alias("action")).agg(F.avg("pnl_c").alias("m"), F.count("*").alias("n"))
    every = g.select("strategy").distinct().withColumn("action", F.explode(F.array(F.lit("Buy"), F.lit("Sell"), F.lit("Hold"))))
    p = every.join(g, ["strategy", "action"], "left").select(
        F.lit(1).alias("schema_version"), F.lit(FEATURE_VERSION).alias("feature_version"), "strategy", "action", F.lit(1).alias("dim"), F.array(F.coalesce("m", F.lit(float("nan")))).alias("mean"), F.array(F.coalesce("n", F.lit(0)).cast("double")).alias("precision"), F.coalesce("n", F.lit(0)).alias("updates")
    )
    to = scratch(spark, "posteriors")
    write_posteriors(p, to)
    return read_posteriors(spark, to).select("strategy", "action", F.round(F.col("mean")[0], 6).alias("mean"), F.round(F.col("precision")[0], 6).alias("precision"))
