"""Risk gates as ordered conditions: the first that fails names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import carried_last, frame_sums, haloed, lagged, numbered, running, runs
from ..plans.registry import query
from ..sources.views import SQL, decisions, ticks, trades

#: Limits in cents: month, week, day (realised), day (marked to market).
MONTHLY_C, WEEKLY_C, DAILY_C, DAILY_MTM_C = -500_000, -250_000, -100_000, -50_000
ZONE = "Europe/Helsinki"


def local_time(ns: Column) -> Column:
    return F.from_utc_timestamp(F.timestamp_micros(F.expr("ts_ns div 1000")), ZONE)


def periods(t: DataFrame) -> DataFrame:
    """Calendar keys of the trading day's zone: day, ISO week, month."""
    x = t.withColumn("local", local_time(F.col("ts_ns")))
    return x.withColumns({
        "day": F.date_format("local", "yyyy-MM-dd"), "week": F.extract(F.lit("YEAROFWEEK"), "local") * 100 + F.extract(F.lit("WEEK"), "local"), "month": F.date_format("local", "yyyy-MM"),
    }).drop("local")


def period_profit(t: DataFrame) -> DataFrame:
    """Realised profit since the start of the day, week and month, by strategy: within a day row by row, of the days before by their totals."""
    x = periods(t)
    days = x.groupBy("strategy", "day", "week", "month").agg(F.sum("pnl_c").alias("total"))
    before = lambda p: F.coalesce(F.sum("total").over(Window.partitionBy("strategy", p).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("strategy", "day", before("week").alias("__week"), before("month").alias("__month"))
    own = Window.partitionBy("strategy", "day").orderBy("ts_ns", "seq").rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(days, ["strategy", "day"]).withColumn("day_pnl_c", F.sum("pnl_c").over(own))
    return x.withColumns({"week_pnl_c": F.col("__week") + F.col("day_pnl_c"), "month_pnl_c": F.col("__month") + F.col("day_pnl_c")}).drop("__week", "__month")


PERIODS = SQL + f""", lt AS (SELECT *, make_timestamp(ts_ns // 1000) AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}' AS loc FROM trades),
pk AS (SELECT *, strftime(loc, '%Y-%m-%d') AS day, CAST(isoyear(loc) * 100 + weekofyear(loc) AS BIGINT) AS week, strftime(loc, '%Y-%m') AS month FROM lt),
pp AS (SELECT *, CAST(sum(pnl_c) OVER (PARTITION BY strategy, day ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS day_pnl_c, CAST(sum(pnl_c) OVER (PARTITION BY strategy, week ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS week_pnl_c,
 CAST(sum(pnl_c) OVER (PARTITION BY strategy, month ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS month_pnl_c FROM pk)
"""


@query(PERIODS + "SELECT strategy, seq, day, week, month, day_pnl_c, week_pnl_c, month_pnl_c FROM pp")
def period_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_profit(trades(spark, sf_dir)).select("strategy", "seq", "day", F.col("week").cast("bigint").alias("week"), "month", "day_pnl_c", "week_pnl_c", "month_pnl_c")


def limit_reason() -> Column:
    """The first hard limit that is passed (strictly below): month before week before day."""
    return F.when(F.col("month_pnl_c") < MONTHLY_C, "monthly_halt").when(F.col("week_pnl_c") < WEEKLY_C, "weekly_halt").when(F.col("day_pnl_c") < DAILY_C, "daily_realized_halt")


LADDER = f"CASE WHEN month_pnl_c < {MONTHLY_C} THEN 'monthly_halt' WHEN week_pnl_c < {WEEKLY_C} THEN 'weekly_halt' WHEN day_pnl_c < {DAILY_C} THEN 'daily_realized_halt' END"


@query(PERIODS + f"""SELECT strategy, seq, {LADDER} AS halt, CASE WHEN day_pnl_c < {DAILY_MTM_C} THEN 0.25 ELSE 1.0 END AS lot_multiplier,
 coalesce({LADDER}, CASE WHEN day_pnl_c < {DAILY_MTM_C} AND abs((k - 50) / 100.0) < 0.01 THEN 'mtm_q_threshold_rejected' END, 'pass') AS outcome FROM pp""")
def risk_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchical limits, the soft daily limit's smaller lot and its threshold on the action value."""
    soft = F.col("day_pnl_c") < DAILY_MTM_C
    q = F.when(soft & (F.abs((F.col("k") - 50) / 100.0) < 0.01), "mtm_q_threshold_rejected")
    return period_profit(trades(spark, sf_dir)).select("strategy", "seq", limit_reason().alias("halt"), F.when(soft, 0.25).otherwise(1.0).alias("lot_multiplier"), F.coalesce(limit_reason(), q, F.lit("pass")).alias("outcome"))


@query(PERIODS + f"SELECT strategy, seq, max(CASE WHEN day_pnl_c < {DAILY_C} THEN 1 ELSE 0 END) OVER (PARTITION BY strategy, day ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) = 1 AS halted FROM pp")
def halt_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A halt stays on until the day's key changes."""
    w = Window.partitionBy("strategy", "day").orderBy("ts_ns", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return period_profit(trades(spark, sf_dir)).select("strategy", "seq", (F.max((F.col("day_pnl_c") < DAILY_C).cast("int")).over(w) == 1).alias("halted"))


def barrier(ms: Column) -> dict[str, Column]:
    """Staleness of the state in milliseconds: multiplier, status and lot."""
    s = F.least(ms.cast("double"), F.lit(5000.0))
    m = F.greatest(F.lit(0.0), 1 - F.pow(s / 5000.0, F.lit(2.0)))
    return {
        "multiplier": m, "status": F.when(ms >= 5000, "Halted").when(ms >= 2000, "Degraded").when(ms >= 1000, "Warning").otherwise("Normal"),
        "lot": F.when(m < 0.01, 0).otherwise(F.least(F.floor(100000 * m), F.lit(1000000))).cast("bigint"),
    }


@query(SQL + """, s AS (SELECT seq, k * 60 AS ms, greatest(0, 1 - pow(least(CAST(k * 60 AS DOUBLE), 5000) / 5000, 2)) AS m FROM trades)
SELECT seq, ms, round(m, 9) AS multiplier, CASE WHEN ms >= 5000 THEN 'Halted' WHEN ms >= 2000 THEN 'Degraded' WHEN ms >= 1000 THEN 'Warning' ELSE 'Normal' END AS status, CASE WHEN m < 0.01 THEN 0 ELSE least(CAST(floor(100000 * m) AS BIGINT), 1000000) END AS lot,
 CASE WHEN m < 0.01 THEN 0 ELSE least(CAST(floor(100000 * m) AS BIGINT), 1000000) END >= 1000 AS allowed FROM s""")
def staleness_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = trades(spark, sf_dir).select("seq", (F.col("k") * 60).alias("ms"))
    b = barrier(F.col("ms"))
    return x.select("seq", "ms", F.round(b["multiplier"], 9).alias("multiplier"), b["status"].alias("status"), b["lot"].alias("lot"), (b["lot"] >= 1000).alias("allowed"))


#: Units that all strategies may hold together, the share from which lower ranks get less, the size of a unit, the least lot.
GLOBAL_LIMIT, SOFT_CAP, UNIT, LEAST_LOT = 10.0, 0.7, 100_000.0, 1000.0
FILLED = "triggered AND direction IS NOT NULL AND skip_reason IS NULL"


@query(SQL + f""", r AS (SELECT seq, strategy, direction, lots, CASE WHEN direction = 'Buy' THEN lots ELSE -lots END / {UNIT} AS delta, coalesce(sum(CASE WHEN {FILLED} THEN CASE WHEN direction = 'Buy' THEN lots ELSE -lots END / {UNIT} ELSE 0 END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position, abs(q_sampled) AS q,
 {", ".join(f"last_value(CASE WHEN strategy = '{x}' THEN abs(q_sampled) END IGNORE NULLS) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS q{x}" for x in "ABC")} FROM decisions),
k AS (SELECT *, {" + ".join(f"CASE WHEN q{x} > q OR (q{x} = q AND '{x}' < strategy) THEN 1 ELSE 0 END" for x in "ABC")} AS rank FROM r WHERE direction IS NOT NULL),
l AS (SELECT *, lots * CASE WHEN rank = 0 OR abs(position) / {GLOBAL_LIMIT} < {SOFT_CAP} THEN 1 ELSE pow(0.5, rank) END AS lot, abs(position + delta) > {GLOBAL_LIMIT} OR abs(position) > {GLOBAL_LIMIT} AS over FROM k)
SELECT seq, CAST(position AS DOUBLE) AS position, CAST(rank AS BIGINT) AS rank, CASE WHEN over OR lot < {LEAST_LOT} THEN 0 ELSE CAST(floor(lot) AS BIGINT) END AS lot, CASE WHEN over THEN 'over_limit' WHEN lot < {LEAST_LOT} THEN 'lot_too_small' ELSE 'ok' END AS outcome FROM l""")
def global_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position limit over all strategies, for each order."""
    return limited(decisions(spark, sf_dir)).select("seq", "position", "rank", "lot", "outcome")


def limited(d: DataFrame, limit: float = GLOBAL_LIMIT, soft: float = SOFT_CAP) -> DataFrame:
    """Orders against what all strategies hold together, from the fills before them: ``position``, ``rank``, ``lot``, ``outcome``.

    An order that would pass the limit, or that comes while it is passed, is
    blocked. Where most of the limit is used, a strategy gets half the lot for
    each one whose last action value is greater (ties by name); too small a
    lot is blocked as well.
    """
    signed = F.when(F.col("direction") == "Buy", F.col("lots")).otherwise(-F.col("lots")) / UNIT
    q, s = F.abs("q_sampled"), F.col("strategy")
    x = running(numbered(d.withColumn("__fill", F.when(F.expr(FILLED), signed).otherwise(0.0)), []), [], {"position": F.col("__fill")})
    x = x.withColumn("position", F.col("position") - F.col("__fill"))
    rank = F.lit(0)
    for name in "ABC":
        x = carried_last(x.withColumn(f"__{name}", F.when(s == name, q)), [], f"__{name}", f"__q{name}")
        rank += F.coalesce(((F.col(f"__q{name}") > q) | ((F.col(f"__q{name}") == q) & (F.lit(name) < s))).cast("int"), F.lit(0))
    x = x.where("direction is not null").withColumn("rank", rank.cast("bigint"))
    lot = F.col("lots") * F.when((F.col("rank") == 0) | (F.abs("position") / limit < soft), 1.0).otherwise(F.pow(F.lit(0.5), F.col("rank")))
    over = (F.abs(F.col("position") + signed) > limit) | (F.abs("position") > limit)
    return x.select(
        *d.columns, "position", "rank", F.when(over | (lot < LEAST_LOT), 0).otherwise(F.floor(lot)).cast("bigint").alias("lot"),
        F.when(over, "over_limit").when(lot < LEAST_LOT, "lot_too_small").otherwise("ok").alias("outcome"),
    )


@query(SQL + """SELECT seq, CAST(floor(least(lots * m * b, b * 100000)) AS BIGINT) AS lot FROM (SELECT seq, lots, CASE WHEN k < 25 THEN CAST(0.25 AS DOUBLE) ELSE 1 END AS m, (event % 4) / CAST(4 AS DOUBLE) AS b FROM (SELECT seq, lots, k, seq AS event FROM trades))""")
def lot_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lot after all multipliers, rounded down."""
    m, b = F.when(F.col("k") < 25, 0.25).otherwise(1.0), (F.col("seq") % 4) / 4.0
    return trades(spark, sf_dir).select("seq", F.floor(F.least(F.col("lots") * m * b, b * 100000)).cast("bigint").alias("lot"))


@query(SQL + """, w AS (SELECT strategy, ts_ns, seq, row_number() OVER (PARTITION BY strategy ORDER BY ts_ns, seq) AS i, avg(pnl_c) OVER r / greatest(stddev_samp(pnl_c) OVER r, 1e-10) AS s FROM trades WINDOW r AS (PARTITION BY strategy ORDER BY ts_ns, seq ROWS 49 PRECEDING)),
b AS (SELECT *, i >= 100 AND s < -0.05 AS bad FROM w), n AS (SELECT *, i - row_number() OVER (PARTITION BY strategy, bad ORDER BY ts_ns, seq) AS island FROM b), c AS (SELECT *, row_number() OVER (PARTITION BY strategy, bad, island ORDER BY ts_ns, seq) AS run FROM n WHERE bad)
SELECT strategy, min(ts_ns) AS dead_ts_ns, count(*) AS n_bad FROM c WHERE run >= 5 GROUP BY strategy""")
def lifecycle_culling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategies that die, by a threshold that these trades can reach."""
    return culled(trades(spark, sf_dir), threshold=-0.05, yearly=1.0)


def culled(t: DataFrame, threshold: float = -1.0, yearly: float = 252.0, episodes: int = 100, row: int = 5, strict: float = 1.5, unknown: Column | None = None) -> DataFrame:
    """When a strategy dies: at so many poor rolling Sharpe ratios (of 50 trades, by the year) in a row, once it has enough episodes; in an unknown regime the threshold is further off."""
    least = F.lit(threshold) if unknown is None else F.when(unknown, threshold * strict).otherwise(threshold)
    x = haloed(numbered(t.select("strategy", "seq", "ts_ns", "pnl_c", least.alias("least")), ["strategy"]), halo=50)
    x = frame_sums(x, Window.partitionBy("strategy", "chunk").orderBy("n"), "pnl_c", (50,)).where("own")
    deviation = F.when(F.col("pnl_c_count_50") > 1, F.sqrt(F.col("pnl_c_m2_50") / (F.col("pnl_c_count_50") - 1)))
    sharpe = F.col("pnl_c_mean_50") / F.greatest(deviation, F.lit(1e-10)) * F.sqrt(F.lit(yearly))
    x = x.select("strategy", "seq", "ts_ns", "n", F.coalesce((F.col("n") >= episodes) & (sharpe < F.col("least")), F.lit(False)).alias("bad"))
    x = runs(x, ["strategy"], F.col("bad")).where(F.col("bad") & (F.col("n") - F.col("begin") + 1 >= row))
    return x.groupBy("strategy").agg(F.min("ts_ns").alias("dead_ts_ns"), F.count("*").alias("n_bad"))


@query(SQL + f""", t AS (SELECT symbol, seq, ts_ns, lag(ts_ns) OVER (PARTITION BY symbol ORDER BY seq) AS before FROM ticks), l AS (SELECT *, isodow(make_timestamp(ts_ns // 1000) AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}') AS d, isodow(make_timestamp(before // 1000) AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}') AS b FROM t)
SELECT symbol, seq, ts_ns - before AS gap_ns FROM l WHERE b <= 5 AND d = 1 AND ts_ns - before >= 600000000000""")
def weekend_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps over a weekend; these quotes have none of twelve hours, so ten minutes."""
    return weekend_gaps(ticks(spark, sf_dir), least_ns=600_000_000_000)


def weekend_gaps(t: DataFrame, least_ns: int = 43_200_000_000_000) -> DataFrame:
    """First quotes of a Monday after a long gap since a weekday, by the trading day's zone."""
    local = lambda c: F.weekday(F.from_utc_timestamp(F.timestamp_micros(F.floor(F.col(c) / 1000)), ZONE))
    x = lagged(numbered(t.select("symbol", "seq", "ts_ns"), ["symbol"]), ["symbol"], {"before": F.col("ts_ns")})
    return x.where((local("before") <= 4) & (local("ts_ns") == 0) & (F.col("ts_ns") - F.col("before") >= least_ns)).select("symbol", "seq", (F.col("ts_ns") - F.col("before")).alias("gap_ns"))


@query(PERIODS + f""", h AS (SELECT strategy, seq, {", ".join(f"max(CASE WHEN {p}_pnl_c < {c} THEN 1 ELSE 0 END) OVER (PARTITION BY strategy, {p} ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) = 1 AS {p}_halted" for p, c in (("day", DAILY_C), ("week", WEEKLY_C), ("month", MONTHLY_C)))} FROM pp) SELECT * FROM h""")
def halt_latches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halts of the day, the week and the month, each on until its key changes: from the first trade of the period that passes its limit on."""
    x = period_profit(trades(spark, sf_dir))
    for p, c in (("day", DAILY_C), ("week", WEEKLY_C), ("month", MONTHLY_C)):
        first = x.where(F.col(f"{p}_pnl_c") < c).groupBy("strategy", p).agg(F.min("seq").alias(f"{p}_from"))
        x = x.join(first, ["strategy", p], "left").withColumn(f"{p}_halted", F.coalesce(F.col("seq") >= F.col(f"{p}_from"), F.lit(False)))
    return x.select("strategy", "seq", "day_halted", "week_halted", "month_halted")
