"""Fill probability, slippage, order type and simulated execution as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.views import SQL, trades


def unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def last_look(alpha: Column, beta: Column, vol: Column) -> Column:
    """Chance that the provider lets the fill stand."""
    return unit(alpha / (alpha + beta) * (1 - 0.1 * vol))


def request_fill(limit: Column, distance: Column) -> Column:
    """Chance that the request itself fills: market, or limit by distance."""
    return F.when(limit, F.greatest(F.lit(0.01), F.least(F.lit(0.95), 0.5 * F.exp(-10 * F.abs(distance))))).otherwise(0.98)


def effective_fill(request: Column, look: Column) -> Column:
    return unit(request * look + 0.02)


def expected_slippage(vol: Column, size: Column, sell: Column, mean: Column) -> Column:
    return vol * (1e-4 * size + 0.01 * F.sqrt(size) + 0.001) - F.when(sell, 5e-5 * size).otherwise(0.0) + mean


def use_limit(p: Column, profit: Column, slippage: Column) -> Column:
    """A limit order is worth it: likely enough, and its expected profit is not below the market order's."""
    return (p >= 0.7) & (p * profit >= profit - F.abs(slippage)) & (profit >= 1e-4)


def evaluated(t: DataFrame) -> DataFrame:
    """Two passes: tentative order type, effective probability, final type, probability again."""
    x = t.withColumns({"vol": F.col("k") / 100.0, "size": F.col("lots") / 100000.0, "sell": F.col("direction") == "Sell", "profit": F.abs("pnl_c") / 10000000.0, "alpha": F.lit(2.0) + F.col("k"), "beta": F.lit(1.0) + F.col("k") % 7})
    x = x.withColumns({"look": last_look(F.col("alpha"), F.col("beta"), F.col("vol")), "slip": expected_slippage(F.col("vol"), F.col("size"), F.col("sell"), F.lit(0.0))})
    x = x.withColumn("first", effective_fill(request_fill(F.lit(False), F.lit(0.0)), F.col("look")))
    x = x.withColumn("limit", use_limit(F.col("first"), F.col("profit"), F.col("slip")))
    return x.withColumn("effective", effective_fill(request_fill(F.col("limit"), 0.5 * F.col("profit")), F.col("look")))


EVALUATED = SQL + """, e0 AS (SELECT *, k / CAST(100 AS DOUBLE) AS vol, lots / CAST(100000 AS DOUBLE) AS size, direction = 'Sell' AS sell, abs(pnl_c) / CAST(10000000 AS DOUBLE) AS profit, 2.0 + k AS alpha, 1.0 + k % 7 AS beta FROM trades),
e1 AS (SELECT *, greatest(0, least(1, CAST(alpha AS DOUBLE) / (alpha + beta) * (1 - 0.1 * vol))) AS look, vol * (CAST(1e-4 AS DOUBLE) * size + 0.01 * sqrt(size) + 0.001) - CASE WHEN sell THEN CAST(5e-5 AS DOUBLE) * size ELSE 0 END AS slip FROM e0),
e2 AS (SELECT *, greatest(0, least(1, 0.98 * look + 0.02)) AS first FROM e1), e3 AS (SELECT *, first >= 0.7 AND first * profit >= profit - abs(slip) AND profit >= 1e-4 AS is_limit FROM e2),
e AS (SELECT *, greatest(0, least(1, CASE WHEN is_limit THEN greatest(0.01, least(0.95, 0.5 * exp(-10 * abs(0.5 * profit)))) ELSE 0.98 END * look + 0.02)) AS effective FROM e3)
"""


@query(EVALUATED + "SELECT seq, round(look, 10) AS last_look, round(effective, 10) AS effective FROM e")
def fill_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(trades(spark, sf_dir)).select("seq", F.round("look", 10).alias("last_look"), F.round("effective", 10).alias("effective"))


@query(EVALUATED + "SELECT seq, round(slip, 9) AS slip FROM e")
def slippage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(trades(spark, sf_dir)).select("seq", F.round("slip", 9).alias("slip"))


@query(EVALUATED + "SELECT CASE WHEN is_limit THEN 'Limit' ELSE 'Market' END AS order_type, direction, count(*) AS n FROM e GROUP BY ALL")
def order_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(trades(spark, sf_dir)).groupBy(F.when(F.col("limit"), "Limit").otherwise("Market").alias("order_type"), "direction").agg(F.count("*").alias("n"))


@query(EVALUATED + """, u AS (SELECT *, ('0x' || substr(md5('fill:' || seq), 1, 8))::BIGINT / CAST(4294967296 AS DOUBLE) AS u FROM e)
SELECT seq, u < effective AS filled, CASE WHEN u < effective THEN CASE WHEN sell THEN -lots ELSE lots END ELSE 0 END AS signed_size, round(CASE WHEN u < effective THEN slip ELSE 0 END, 9) AS drift, round(CASE WHEN u < effective THEN 1 ELSE 0 END - effective, 10) AS prediction_error,
 CASE WHEN u < effective THEN NULL WHEN look < 0.5 THEN 'LAST_LOOK' ELSE 'INSUFFICIENT_LIQUIDITY' END AS reject_reason, round(0.5 + 2 * u, 8) AS latency_ms FROM u""")
def execution_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated execution by a draw that is a hash of the order, so any run and any partitioning gives the same."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit("fill:"), F.col("seq").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    x = evaluated(trades(spark, sf_dir)).withColumn("u", u)
    ok = F.col("u") < F.col("effective")
    return x.select(
        "seq", ok.alias("filled"), F.when(ok, F.when(F.col("sell"), -F.col("lots")).otherwise(F.col("lots"))).otherwise(0).cast("bigint").alias("signed_size"), F.round(F.when(ok, F.col("slip")).otherwise(0.0), 9).alias("drift"),
        F.round(ok.cast("double") - F.col("effective"), 10).alias("prediction_error"), F.when(ok, None).when(F.col("look") < 0.5, "LAST_LOOK").otherwise("INSUFFICIENT_LIQUIDITY").alias("reject_reason"), F.round(0.5 + 2 * F.col("u"), 8).alias("latency_ms"),
    )


@query(SQL + """SELECT strategy, seq, CASE WHEN abs(qb - qs) / (greatest(abs(qb), abs(qs)) + 1e-15) < 0.05 AND qb > 0 AND qs > 0 THEN 'Hold' WHEN qb >= qs AND qb >= 0 THEN 'Buy' WHEN qs >= 0 THEN 'Sell' ELSE 'Hold' END AS action FROM (SELECT strategy, seq, (k - 50) / CAST(100 AS DOUBLE) AS qb, (50 - seq % 100) / CAST(100 AS DOUBLE) AS qs FROM trades)""")
def action_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest action value with the order Buy, Sell, Hold for ties; nearly equal positive values mean Hold."""
    qb, qs = (F.col("k") - 50) / 100.0, (50 - F.col("seq") % 100) / 100.0
    near = (F.abs(qb - qs) / (F.greatest(F.abs(qb), F.abs(qs)) + 1e-15) < 0.05) & (qb > 0) & (qs > 0)
    return trades(spark, sf_dir).select("strategy", "seq", F.when(near, "Hold").when((qb >= qs) & (qb >= 0), "Buy").when(qs >= 0, "Sell").otherwise("Hold").alias("action"))


def _draw(salt: str) -> Column:
    """A number in (0, 1) that is a hash of the order."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(salt + ":"), F.col("seq").cast("string"))), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def _normal(i: int) -> Column:
    return F.sqrt(-2 * F.log(_draw(f"r{i}"))) * F.cos(2 * 3.141592653589793 * _draw(f"a{i}"))


def student_t3() -> Column:
    """A draw of Student's t with three degrees of freedom: a normal over the root of the mean of three squared ones."""
    return _normal(0) / F.sqrt(sum((_normal(i) * _normal(i) for i in (1, 2, 3)), F.lit(0.0)) / 3)


def fill_price(mid: Column, spread: Column, sell: Column, slip: Column) -> Column:
    """Across the spread, and worse by the slippage."""
    return F.when(sell, mid - spread / 2 - slip).otherwise(mid + spread / 2 + slip)


_SQL_DRAW = "(('0x' || substr(md5('{}:' || seq), 1, 8))::BIGINT + 0.5) / CAST(4294967296 AS DOUBLE)"
_SQL_NORMAL = ["sqrt(-2 * ln(" + _SQL_DRAW.format(f"r{i}") + ")) * cos(2 * 3.141592653589793 * " + _SQL_DRAW.format(f"a{i}") + ")" for i in range(4)]
SAMPLED = EVALUATED + f""", z AS (SELECT *, {", ".join(f"{n} AS z{i}" for i, n in enumerate(_SQL_NORMAL))} FROM e), sl AS (SELECT *, z0 / sqrt((z1 * z1 + z2 * z2 + z3 * z3) / 3) AS t3 FROM z)
"""


@query(SAMPLED + "SELECT seq, round(slip + t3 * CAST(1e-4 AS DOUBLE) * (1 + size * vol), 8) AS slip, round(greatest(0, least(1, 0.98 * look + 0.02 + greatest(t3 * 0.01 + 0.02, 0))), 7) AS fill_probability FROM sl")
def sampled_slippage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slippage and fill probability with heavy-tailed noise; draws are hashes, so any run gives the same."""
    x = evaluated(trades(spark, sf_dir)).withColumn("t3", student_t3())
    p = unit(0.98 * F.col("look") + 0.02 + F.greatest(F.col("t3") * 0.01 + 0.02, F.lit(0.0)))
    return x.select("seq", F.round(F.col("slip") + F.col("t3") * 1e-4 * (1 + F.col("size") * F.col("vol")), 8).alias("slip"), F.round(p, 7).alias("fill_probability"))


@query(EVALUATED + """, u AS (SELECT e.*, ('0x' || substr(md5('fill:' || e.seq), 1, 8))::BIGINT / CAST(4294967296 AS DOUBLE) AS u, t.bid, t.ask FROM e JOIN ticks t ON t.seq = e.seq)
SELECT seq, CASE WHEN u < effective THEN 'Filled' ELSE 'Rejected' END AS status, round(CASE WHEN u >= effective THEN NULL WHEN sell THEN bid - slip ELSE ask + slip END, 6) AS price, round(0.5 + 2 * u, 3) AS latency_ms, round(effective, 4) AS probability FROM u""")
def paper_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated fills as a paper account shows them: price across the spread, rounded."""
    from ..sources.views import ticks

    u = F.conv(F.substring(F.md5(F.concat(F.lit("fill:"), F.col("seq").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    x = evaluated(trades(spark, sf_dir)).join(ticks(spark, sf_dir).select("seq", "bid", "ask"), "seq").withColumn("u", u)
    ok = F.col("u") < F.col("effective")
    price = fill_price((F.col("bid") + F.col("ask")) / 2, F.col("ask") - F.col("bid"), F.col("sell"), F.col("slip"))
    return x.select("seq", F.when(ok, "Filled").otherwise("Rejected").alias("status"), F.round(F.when(ok, price), 6).alias("price"), F.round(0.5 + 2 * F.col("u"), 3).alias("latency_ms"), F.round("effective", 4).alias("probability"))


#: Longest holding of a position by strategy in milliseconds.
MAX_HOLD_MS = {"A": 30_000, "B": 300_000, "C": 600_000}


@query(SQL + "SELECT seq, strategy, k * 7000 AS held_ms FROM trades WHERE k * 7000 >= CASE strategy WHEN 'A' THEN 30000 WHEN 'B' THEN 300000 ELSE 600000 END")
def max_hold_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions (here held k times seven seconds) that have reached their strategy's longest holding."""
    most = F.element_at(F.create_map(*[F.lit(x) for kv in MAX_HOLD_MS.items() for x in kv]), F.col("strategy"))
    return trades(spark, sf_dir).select("seq", "strategy", (F.col("k") * 7000).alias("held_ms")).where(F.col("held_ms") >= most)
