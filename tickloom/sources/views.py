"""Market views of the events table: quotes, trades, decisions, returns and session messages.

Every derived value is an integer or an exact function of integers, so any
engine gives the same rows. Times are BIGINT nanoseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(spark: SparkSession, sf_dir: str, low_ns: int | None = None, high_ns: int | None = None) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = e.schema["ts"].dataType.simpleString()
    at = lambda us: F.timestamp_micros(F.lit(us)).cast(kind)
    if low_ns is not None:  # on the stored column, so that the scan prunes
        e = e.where(F.col("ts") >= at(-(-low_ns // 1000)))
    if high_ns is not None:
        e = e.where(F.col("ts") <= at(high_ns // 1000))
    return e.select(
        "event_id", "user_id", "event_type",
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        F.round(F.col("value") * 100).cast("bigint").alias("c"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def ticks(spark: SparkSession, sf_dir: str, low_ns: int | None = None, high_ns: int | None = None) -> DataFrame:
    """Quotes (of a range of time, both ends included): symbol, seq, ts_ns, bid, ask, bid_size, ask_size."""
    mid, half = F.lit(100) + F.col("c") / 10000.0, (F.lit(1) + F.col("event_id") % 7) / 1000.0
    return _base(spark, sf_dir, low_ns, high_ns).select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), "ts_ns", (mid - half).alias("bid"), (mid + half).alias("ask"),
        (1000 * (1 + F.col("k"))).cast("double").alias("bid_size"), (1000 * (1 + F.col("event_id") % 50)).cast("double").alias("ask_size"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills with their profit in cents."""
    u, i = F.col("user_id"), F.col("event_id")
    return _base(spark, sf_dir).select(
        i.alias("seq"), "ts_ns", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (u % 3 + 1).cast("int")).alias("strategy"),
        F.when(i % 2 == 0, "Buy").otherwise("Sell").alias("direction"), F.lit(100000).cast("bigint").alias("lots"), (F.col("c") - 5000).alias("pnl_c"),
        ((i % 11 - 5) / 10000.0).alias("slippage"), (0.5 + F.col("k") / 200.0).alias("fill_probability"), (0.5 + (i % 20) / 10.0).alias("latency_ms"),
        F.when(F.col("event_type") == "purchase", "TRIGGER_EXIT").when(F.col("event_type") == "error", "MAX_HOLD_TIME").alias("close_reason"),
        F.when(u % 2 == 0, "LP_PRIMARY").otherwise("LP_BACKUP").alias("lp_id"), "k",
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions: trades with trigger, reason to skip and sampled action value."""
    k = F.col("k")
    reason = F.when(k < 10, "gap_detected").when(k < 20, "kill_switch_masked").when(k < 35, "trigger conditions not met").when(k < 45, "risk_limit_rejected").when((k >= 90), "execution_rejected")
    return trades(spark, sf_dir).withColumns({
        "triggered": k >= 50, "skip_reason": reason, "direction": F.when(k >= 30, F.col("direction")), "q_sampled": (k - 50) / 100.0,
    })


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One return series for each strategy: strategy, obs (from 1, by time), ret."""
    t = numbered(trades(spark, sf_dir).select("strategy", "seq", "pnl_c"), ["strategy"])
    return t.select("strategy", F.col("n").alias("obs"), (F.col("pnl_c") / 10000.0).alias("ret"))


#: The same views for DuckDB.
SQL = """WITH base AS (SELECT event_id, user_id, event_type, epoch_us(ts) * 1000 AS ts_ns, CAST(round(value * 100) AS BIGINT) AS c, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
ticks AS (SELECT event_type AS symbol, event_id AS seq, ts_ns, (100 + c / CAST(10000 AS DOUBLE)) - (1 + event_id % 7) / CAST(1000 AS DOUBLE) AS bid, (100 + c / CAST(10000 AS DOUBLE)) + (1 + event_id % 7) / CAST(1000 AS DOUBLE) AS ask,
  CAST(1000 * (1 + k) AS DOUBLE) AS bid_size, CAST(1000 * (1 + event_id % 50) AS DOUBLE) AS ask_size FROM base),
trades AS (SELECT event_id AS seq, ts_ns, CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS strategy, CASE WHEN event_id % 2 = 0 THEN 'Buy' ELSE 'Sell' END AS direction, CAST(100000 AS BIGINT) AS lots, c - 5000 AS pnl_c,
  (event_id % 11 - 5) / CAST(10000 AS DOUBLE) AS slippage, CAST(0.5 AS DOUBLE) + k / CAST(200 AS DOUBLE) AS fill_probability, CAST(0.5 AS DOUBLE) + (event_id % 20) / CAST(10 AS DOUBLE) AS latency_ms,
  CASE event_type WHEN 'purchase' THEN 'TRIGGER_EXIT' WHEN 'error' THEN 'MAX_HOLD_TIME' END AS close_reason, CASE WHEN user_id % 2 = 0 THEN 'LP_PRIMARY' ELSE 'LP_BACKUP' END AS lp_id, k FROM base),
decisions AS (SELECT seq, ts_ns, strategy, CASE WHEN k >= 30 THEN direction END AS direction, lots, pnl_c, slippage, fill_probability, latency_ms, close_reason, lp_id, k, k >= 50 AS triggered,
  CASE WHEN k < 10 THEN 'gap_detected' WHEN k < 20 THEN 'kill_switch_masked' WHEN k < 35 THEN 'trigger conditions not met' WHEN k < 45 THEN 'risk_limit_rejected' WHEN k >= 90 THEN 'execution_rejected' END AS skip_reason, (k - 50) / CAST(100 AS DOUBLE) AS q_sampled FROM trades),
rets AS (SELECT strategy, row_number() OVER (PARTITION BY strategy ORDER BY ts_ns, seq) AS obs, pnl_c / CAST(10000 AS DOUBLE) AS ret FROM trades)
"""
