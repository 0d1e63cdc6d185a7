"""Recorded events: a store by stream and sequence, differences of payloads, cold files of what has expired, files by their kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import numbered
from ..plans.registry import query
from . import quotes
from .results import scratch
from .views import SQL, ticks

#: Every so many payloads one is kept whole; nanoseconds that a raw event is kept.
EVERY, TTL_NS = 10, 7 * 86_400_000_000_000


def from_stream(events: DataFrame, stream: str, seq: int) -> DataFrame:
    """Events of a stream from a sequence number on, in no order."""
    return events.where((F.col("symbol") == stream) & (F.col("seq") >= seq))


@query(SQL + "SELECT symbol, seq, round(bid, 6) AS bid FROM ticks WHERE symbol = 'click' AND seq >= 500")
def stream_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_stream(ticks(spark, sf_dir), "click", 500).select("symbol", "seq", F.round("bid", 6).alias("bid"))


def differences(x: DataFrame, payload: Column, every: int = EVERY) -> DataFrame:
    """Numbered events with ``base`` (whether the payload is kept whole) and ``stored``: the payload, or its exclusive or with the one before."""
    x = x.withColumns({"payload": payload, "part": F.floor((F.col("n") - 1) / every)})
    before = F.lag("payload").over(Window.partitionBy("symbol", "part").orderBy("n"))
    return x.withColumn("base", (F.col("n") - 1) % every == 0).withColumn("stored", F.when(F.col("base"), F.col("payload")).otherwise(F.col("payload").bitwiseXOR(before)))


def restored(x: DataFrame) -> Column:
    """The payload again: exclusive or of all that is stored since the last whole one."""
    return F.bit_xor("stored").over(Window.partitionBy("symbol", "part").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))


@query(SQL + """, p AS (SELECT symbol, seq, row_number() OVER (PARTITION BY symbol ORDER BY seq) - 1 AS n, CAST(round(bid * 10000) AS BIGINT) * 4096 + seq % 4096 AS payload FROM ticks)
SELECT symbol, seq, n % 10 = 0 AS base, CASE WHEN n % 10 = 0 THEN payload ELSE xor(payload, lag(payload) OVER (PARTITION BY symbol ORDER BY n)) END AS stored, payload AS restored FROM p""")
def xor_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads stored as differences and restored."""
    x = differences(numbered(ticks(spark, sf_dir), ["symbol"]), F.round(F.col("bid") * 10000).cast("bigint") * 4096 + F.col("seq") % 4096)
    return x.select("symbol", "seq", "base", "stored", restored(x).alias("restored"))


def archive(events: DataFrame, now: Column, to: str, ttl_ns: int = TTL_NS) -> DataFrame:
    """Write what has expired as JSON lines in a folder for each symbol; the events that stay."""
    old = F.col("ts_ns") < now - ttl_ns
    events.where(old).write.partitionBy("symbol").json(to)
    return events.where(~old)


@query(SQL + f", m AS (SELECT max(ts_ns) - {TTL_NS} AS cut FROM ticks) SELECT symbol, count(*) FILTER (ts_ns < cut) AS archived, count(*) FILTER (ts_ns >= cut) AS kept FROM ticks, m GROUP BY symbol")
def archive_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expired quotes moved to cold files, and read there."""
    t = ticks(spark, sf_dir).select("symbol", "seq", "ts_ns")
    now = F.lit(t.agg(F.max("ts_ns")).first()[0])
    to = scratch(spark, "cold")
    kept = archive(t, now, to).groupBy("symbol").agg(F.count("*").alias("kept"))
    cold = spark.read.schema("seq bigint, ts_ns bigint, symbol string").json(to).groupBy("symbol").agg(F.count("*").alias("archived"))
    return kept.join(cold, "symbol", "full").select("symbol", F.coalesce("archived", F.lit(0)).alias("archived"), F.coalesce("kept", F.lit(0)).alias("kept"))


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """A quote file by its kind: CSV, which must be without fault, else a stored table."""
    return quotes.strict(quotes.read_csv(spark, path)) if path.lower().rstrip("/").endswith(".csv") else spark.read.parquet(path)
