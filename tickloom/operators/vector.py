"""The full feature vector of a quote: market features, the position as of the quote, recent fills, lagged execution means; strategy extras; form for a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import asof_all, ema, numbered, recent
from ..functions.stored import stored
from ..plans.registry import query, settled, settled_sql
from ..sources.views import ticks, trades
from .features import FEATURES, SESSIONS, features, sanitise

#: The order of the vector.
VECTOR = (
    "spread", "spread_zscore", "obi", "delta_obi", "depth_change_rate", "queue_position", "realized_volatility", "volatility_ratio", "volatility_decay_rate", "session_tokyo", "session_london", "session_ny",
    "session_sydney", "time_since_open_ms", "time_since_last_spike_ms", "holding_time_ms", "position_size", "position_direction", "entry_price", "pnl_unrealized", "trade_intensity", "signed_volume", "recent_fill_rate",
    "recent_slippage", "recent_reject_rate", "execution_drift_trend", "self_impact", "time_decay", "dynamic_cost", "p_revert", "p_continue", "p_trend", "spread_z_x_vol", "obi_x_session", "depth_drop_x_vol_spike",
    "position_size_x_vol", "obi_x_vol", "spread_z_x_self_impact",
)
#: Lot that impact is measured by, decay of a held position's value per millisecond, weight of the execution means, their delay and the frame of recent fills in nanoseconds, a spike's reach and a day in milliseconds.
TYPICAL_LOT, DECAY, ALPHA, LAG_NS, FRAME_NS, SPIKE_MS, DAY_MS = 1000.0, 0.01, 0.05, 500_000_000, 60_000_000_000, 5000.0, 86_400_000.0
#: Places that are times: at least zero, and one of them at most a day.
TIMES, CAPPED = (13, 15), 14


def unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def positions(t: DataFrame) -> DataFrame:
    """State of a position after each fill: seq, ts_ns, size, entry_price, unrealized, opened_ns."""
    i = F.col("seq")
    return t.select("seq", "ts_ns", ((i % 5 - 2) * 1000).cast("double").alias("size"), (100 + (i % 97) / 100.0).alias("entry"), ((i % 41 - 20) * 10).cast("double").alias("unrealized"), F.col("ts_ns").alias("opened_ns"))


def executions(t: DataFrame) -> DataFrame:
    """Outcomes of orders, numbered, with their exponential means: fills, absolute slippage, rejections, drift."""
    fill = (F.col("k") % 5 != 0).cast("double")
    e = numbered(t.select("seq", "ts_ns", fill.alias("fill"), (1 - fill).alias("reject"), F.abs("slippage").alias("slip"), ((F.col("seq") % 13 - 6) / 100000.0).alias("drift"), (fill * F.when(F.col("direction") == "Buy", F.col("lots")).otherwise(-F.col("lots"))).alias("signed")), [])
    return ema(e, [], {"fill_ema": ("fill", 0.0), "slip_ema": ("slip", 0.0), "reject_ema": ("reject", 0.0), "drift_ema": ("drift", 0.0)}, ALPHA)


def vector(t: DataFrame, own: DataFrame, fills: DataFrame) -> DataFrame:
    """Quotes with the 38 features. ``own``: states of the strategy's position, ``fills``: executions with their means."""
    x = features(t)
    x = asof_all(x, [(own, ["size", "entry", "unrealized", "opened_ns"]), (fills, ["fill_ema", "slip_ema", "reject_ema", "drift_ema"])], times=t)
    x = recent(x, fills, {"trade_intensity": F.col("fill"), "signed_volume": F.col("signed")}, FRAME_NS)
    first = fills.where("n = 1").select(F.col("ts_ns").alias("first_ns"))  # one row
    x = x.join(F.broadcast(first), F.lit(True), "left")
    size, rv, obi, z, vr = F.coalesce("size", F.lit(0.0)), F.col("rv"), F.col("obi"), F.col("spread_z"), F.col("volatility_ratio")
    seen = F.coalesce(F.col("ts_ns") - F.col("first_ns") >= LAG_NS, F.lit(False))
    lagged = lambda c: F.when(seen, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    x = x.withColumns({
        "position_size": size, "holding_time_ms": F.when(size != 0, F.floor((F.col("ts_ns") - F.col("opened_ns")) / 1000000)).otherwise(0).cast("double"),
        "self_impact": F.abs(size) / TYPICAL_LOT * rv, "time_since_open_ms": F.col("open_ms").cast("double"), "time_since_last_spike_ms": F.col("spike_ms").cast("double"),
    })
    return x.withColumns({
        "spread_zscore": z, "realized_volatility": rv, "volatility_decay_rate": F.col("volatility_decay"), **{f"session_{s}": (F.col("session") == i).cast("double") for i, s in enumerate(SESSIONS)},
        "queue_position": F.when(F.col("bid_size") > 0, F.least(F.abs("position_size") / F.col("bid_size"), F.lit(1.0))).otherwise(0.0), "position_direction": F.signum("position_size"),
        "entry_price": F.coalesce("entry", F.lit(0.0)), "pnl_unrealized": F.coalesce("unrealized", F.lit(0.0)), "recent_fill_rate": lagged("fill_ema"), "recent_slippage": lagged("slip_ema"), "recent_reject_rate": lagged("reject_ema"),
        "execution_drift_trend": lagged("drift_ema"), "time_decay": F.when(F.col("holding_time_ms") <= 0, 1.0).otherwise(F.exp(-DECAY * F.col("holding_time_ms"))),
        "p_continue": unit(0.6 * unit(2 * F.greatest(vr - 1, F.lit(0.0))) + 0.4 * F.least(F.col("trade_intensity") / 20, F.lit(1.0))),
        "spread_z_x_vol": z * rv, "obi_x_session": obi * F.col("session"), "depth_drop_x_vol_spike": F.when(F.col("time_since_last_spike_ms") < SPIKE_MS, F.col("depth_change_rate")).otherwise(0.0),
        "position_size_x_vol": F.abs("position_size") * rv, "obi_x_vol": obi * rv, "spread_z_x_self_impact": z * F.col("self_impact"),
    })


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(spark, sf_dir, ticks(spark, sf_dir))


def loaded(spark: SparkSession, sf_dir: str, quotes: DataFrame) -> DataFrame:
    """The features of given quotes, whose further columns stay; executions are read several times and written once."""
    t = trades(spark, sf_dir)
    return vector(quotes, positions(t.where("strategy = 'A'")), stored(executions(t).select("seq", "ts_ns", "n", "fill", "signed", "fill_ema", "slip_ema", "reject_ema", "drift_ema"), "executions"))


#: The same in SQL: the means by their plain weighted sums over the last 600 outcomes, the fills by a range join.
VECTOR_SQL = FEATURES + f""", ex AS (SELECT seq, ts_ns, row_number() OVER (ORDER BY seq) AS n, CASE WHEN k % 5 <> 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS fill, abs(slippage) AS slip, (seq % 13 - 6) / CAST(100000 AS DOUBLE) AS drift, CASE WHEN k % 5 = 0 THEN 0 WHEN direction = 'Buy' THEN lots ELSE -lots END AS signed FROM trades),
em AS (SELECT a.ts_ns, sum(0.05 * pow(0.95, a.n - b.n) * b.fill) AS fill_ema, sum(0.05 * pow(0.95, a.n - b.n) * b.slip) AS slip_ema, sum(0.05 * pow(0.95, a.n - b.n) * (1 - b.fill)) AS reject_ema, sum(0.05 * pow(0.95, a.n - b.n) * b.drift) AS drift_ema FROM ex a JOIN ex b ON b.n BETWEEN a.n - 599 AND a.n GROUP BY a.n, a.ts_ns),
po AS (SELECT ts_ns, CAST((seq % 5 - 2) * 1000 AS DOUBLE) AS size, 100 + (seq % 97) / CAST(100 AS DOUBLE) AS entry, CAST((seq % 41 - 20) * 10 AS DOUBLE) AS unrealized, ts_ns AS opened_ns FROM trades WHERE strategy = 'A'),
rf AS (SELECT t.seq, coalesce(sum(e.fill), 0) AS trade_intensity, coalesce(sum(e.signed), 0) AS signed_volume FROM ticks t LEFT JOIN ex e ON e.ts_ns BETWEEN t.ts_ns - {FRAME_NS} AND t.ts_ns GROUP BY t.seq),
j0 AS (SELECT f.*, coalesce(p.size, 0) AS position_size, p.entry, p.unrealized, p.opened_ns FROM f ASOF LEFT JOIN po p ON f.ts_ns >= p.ts_ns), j1 AS (SELECT j0.*, m.fill_ema, m.slip_ema, m.reject_ema, m.drift_ema FROM j0 ASOF LEFT JOIN em m ON j0.ts_ns >= m.ts_ns),
j2 AS (SELECT j1.*, rf.trade_intensity, rf.signed_volume, j1.ts_ns - (SELECT min(ts_ns) FROM ex) >= {LAG_NS} AS seen, CASE WHEN position_size <> 0 THEN CAST((j1.ts_ns - opened_ns) // 1000000 AS DOUBLE) ELSE 0 END AS holding_time_ms, abs(position_size) / 1000 * rv AS self_impact FROM j1 JOIN rf USING (seq)),
v AS (SELECT symbol, seq, spread, spread_z AS spread_zscore, obi, delta_obi, depth_change_rate, CASE WHEN bid_size > 0 THEN least(abs(position_size) / bid_size, 1) ELSE 0 END AS queue_position, rv AS realized_volatility, volatility_ratio, volatility_decay AS volatility_decay_rate,
 CAST(session = 0 AS DOUBLE) AS session_tokyo, CAST(session = 1 AS DOUBLE) AS session_london, CAST(session = 2 AS DOUBLE) AS session_ny, CAST(session = 3 AS DOUBLE) AS session_sydney, CAST(open_ms AS DOUBLE) AS time_since_open_ms, CAST(86400000 AS DOUBLE) AS time_since_last_spike_ms, holding_time_ms, position_size, CAST(sign(position_size) AS DOUBLE) AS position_direction,
 coalesce(entry, 0) AS entry_price, coalesce(unrealized, 0) AS pnl_unrealized, trade_intensity, signed_volume, CASE WHEN seen THEN coalesce(fill_ema, 0) ELSE 0 END AS recent_fill_rate, CASE WHEN seen THEN coalesce(slip_ema, 0) ELSE 0 END AS recent_slippage, CASE WHEN seen THEN coalesce(reject_ema, 0) ELSE 0 END AS recent_reject_rate, CASE WHEN seen THEN coalesce(drift_ema, 0) ELSE 0 END AS execution_drift_trend,
 self_impact, CASE WHEN holding_time_ms <= 0 THEN 1 ELSE exp(-0.01 * holding_time_ms) END AS time_decay, dynamic_cost, p_revert, greatest(0, least(1, 0.6 * least(1, 2 * greatest(volatility_ratio - 1, 0)) + 0.4 * least(trade_intensity / 20, 1))) AS p_continue, p_trend, spread_z * rv AS spread_z_x_vol, obi * session AS obi_x_session, CAST(0 AS DOUBLE) AS depth_drop_x_vol_spike,
 abs(position_size) * rv AS position_size_x_vol, obi * rv AS obi_x_vol, spread_z * self_impact AS spread_z_x_self_impact FROM j2)
"""
#: Decimals that any engine agrees on.
PLACES = {"volatility_ratio": 4, "volatility_decay_rate": 4, "p_continue": 4, "spread_zscore": 5, "p_revert": 5, "spread_z_x_self_impact": 5, "spread_z_x_vol": 6}


def _rounded(names: tuple[str, ...]) -> str:
    return ", ".join(f"{settled_sql(n, PLACES.get(n, 6))} AS {n}" for n in names)


def rounded(x: DataFrame, names: tuple[str, ...]) -> list[Column]:
    return [settled(F.col(n), PLACES.get(n, 6)).alias(n) for n in names]


@query(VECTOR_SQL + f"SELECT symbol, seq, {_rounded(VECTOR)} FROM v")
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 38 features of each quote, as the first strategy sees it."""
    x = load(spark, sf_dir)
    return x.select("symbol", "seq", *rounded(x, VECTOR))


@query(VECTOR_SQL + "SELECT symbol, seq, round(dynamic_cost, 7) AS dynamic_cost, round(p_revert, 6) AS p_revert, round(p_continue, 5) AS p_continue, round(p_trend, 7) AS p_trend FROM v")
def cost_and_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost and heuristic probabilities; that of a move going on takes the intensity of fills into account."""
    x = recent(features(ticks(spark, sf_dir)), executions(trades(spark, sf_dir)), {"trade_intensity": F.col("fill")}, FRAME_NS)
    go_on = unit(0.6 * unit(2 * F.greatest(F.col("volatility_ratio") - 1, F.lit(0.0))) + 0.4 * F.least(F.col("trade_intensity") / 20, F.lit(1.0)))
    return x.select("symbol", "seq", F.round("dynamic_cost", 7).alias("dynamic_cost"), F.round("p_revert", 6).alias("p_revert"), F.round(go_on, 5).alias("p_continue"), F.round("p_trend", 7).alias("p_trend"))


def flatten(x: DataFrame, names: tuple[str, ...] = VECTOR, at: str = "vector") -> DataFrame:
    """Named columns as one array in fixed order."""
    return x.withColumn(at, F.array(*[F.col(n).cast("double") for n in names]))


def unflatten(x: DataFrame, names: tuple[str, ...] = VECTOR, at: str = "vector") -> DataFrame:
    """The array as named columns; null where its length is not theirs."""
    fits = F.size(at) == len(names)
    return x.withColumns({n: F.when(fits, F.element_at(at, i + 1)) for i, n in enumerate(names)})


def for_model(at: str = "vector") -> Column:
    """A vector of any length without values that a model can't take: non-finite ones are zero, times are not negative, one is at most a day."""
    return F.transform(at, lambda x, i: F.when(i == CAPPED, sanitise(x, 0.0, DAY_MS, DAY_MS)).when(i.isin(*TIMES), sanitise(x, 0.0)).otherwise(sanitise(x)))


def columns_for_model(names: tuple[str, ...] = VECTOR) -> Column:
    """The same array from columns: times by themselves, then one short rule for every place, which none of those values breaks."""
    own = [sanitise(F.col(n), 0.0, DAY_MS, DAY_MS) if i == CAPPED else sanitise(F.col(n), 0.0) if i in TIMES else F.col(n).cast("double") for i, n in enumerate(names)]
    return F.transform(F.array(*own), lambda v: sanitise(v))


@query(VECTOR_SQL + f"SELECT symbol, seq, CAST(38 AS BIGINT) AS dim, {_rounded(VECTOR[:9] + VECTOR[19:32])}, true AS short_is_null FROM v")
def flatten_unflatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vector to array and back; an array of another length gives nulls."""
    x = flatten(load(spark, sf_dir)).select("symbol", "seq", for_model().alias("vector"), F.slice("vector", 1, 2).alias("short"))
    x = unflatten(x, at="short").select("symbol", "seq", "vector", F.col("spread").isNull().alias("short_is_null"))
    names, back = VECTOR[:9] + VECTOR[19:32], unflatten(x)
    return back.select("symbol", "seq", F.size("vector").cast("bigint").alias("dim"), *rounded(back, names), "short_is_null")


def extras(x: DataFrame) -> DataFrame:
    """Five further features for each of the three strategies: a1..a5, b1..b5, c1..c5."""
    z, obi, rv, vr, dcr, held = (F.col(c) for c in ("spread_zscore", "obi", "realized_volatility", "volatility_ratio", "depth_change_rate", "holding_time_ms"))
    one = lambda c: F.least(c, F.lit(1.0))
    decay = lambda r: F.when(held <= 0, 1.0).otherwise(F.exp(-r * held))
    dominant = F.greatest(*[F.col(f"session_{s}") for s in SESSIONS])
    depth = F.when(dcr < -0.2, one((-dcr - 0.2) / 0.8)).otherwise(0.0)
    vol = F.when(vr > 1, one((vr - 1) / 2)).otherwise(0.0)
    fading = F.when(F.col("volatility_decay_rate") < 0, one(-F.col("volatility_decay_rate"))).otherwise(0.0)
    early = F.when(F.col("time_since_open_ms") > 0, F.exp(-F.col("time_since_open_ms") / 3_600_000.0)).otherwise(1.0)
    return x.withColumns({
        "a1": z * obi, "a2": F.col("self_impact") * (1 + F.least(F.abs(dcr), F.lit(2.0))), "a3": unit(0.4 * one(F.abs(z) / 3) + 0.35 * depth + 0.25 * vol), "a4": decay(0.001), "a5": dcr * rv,
        "b1": rv * obi, "b2": F.col("delta_obi") * F.col("trade_intensity"), "b3": unit(0.4 * fading + 0.35 * one(F.abs(obi)) + 0.25 * one(F.col("trade_intensity") / 10)), "b4": decay(0.0001), "b5": vr * F.col("signed_volume"),
        "c1": obi * dominant, "c2": dcr * F.col("queue_position"), "c3": unit(0.4 * one(F.abs(obi)) + 0.35 * dominant + 0.25 * early), "c4": decay(0.00005), "c5": obi * F.least(F.col("time_since_open_ms") / 1_000_000.0, F.lit(60.0)),
    })


EXTRAS = {**{f"{s}{i}": 6 for s in "abc" for i in range(1, 6)}, "a1": 5, "a3": 4, "b3": 4, "b5": 0}


@query(VECTOR_SQL + """, x AS (SELECT symbol, seq, spread_zscore * obi AS a1, self_impact * (1 + least(abs(depth_change_rate), 2)) AS a2, 0.4 * least(abs(spread_zscore) / 3, 1) + 0.35 * CASE WHEN depth_change_rate < -0.2 THEN least((-depth_change_rate - 0.2) / 0.8, 1) ELSE 0 END + 0.25 * CASE WHEN volatility_ratio > 1 THEN least((volatility_ratio - 1) / 2, 1) ELSE 0 END AS a3,
 CASE WHEN holding_time_ms <= 0 THEN 1 ELSE exp(-0.001 * holding_time_ms) END AS a4, depth_change_rate * realized_volatility AS a5, realized_volatility * obi AS b1, delta_obi * trade_intensity AS b2, 0.4 * CASE WHEN volatility_decay_rate < 0 THEN least(-volatility_decay_rate, 1) ELSE 0 END + 0.35 * least(abs(obi), 1) + 0.25 * least(trade_intensity / 10, 1) AS b3,
 CASE WHEN holding_time_ms <= 0 THEN 1 ELSE exp(-0.0001 * holding_time_ms) END AS b4, volatility_ratio * signed_volume AS b5, obi * greatest(session_tokyo, session_london, session_ny, session_sydney) AS c1, depth_change_rate * queue_position AS c2, 0.4 * least(abs(obi), 1) + 0.35 + 0.25 * CASE WHEN time_since_open_ms > 0 THEN exp(-time_since_open_ms / 3600000) ELSE 1 END AS c3,
 CASE WHEN holding_time_ms <= 0 THEN 1 ELSE exp(-0.00005 * holding_time_ms) END AS c4, obi * least(time_since_open_ms / 1000000, 60) AS c5 FROM v) SELECT symbol, seq, """ + ", ".join(f"{settled_sql(c, n)} AS {c}" for c, n in EXTRAS.items()) + " FROM x")  # fmt: skip
def strategy_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategies' own features; with the common ones each strategy has 43."""
    x = extras(load(spark, sf_dir))
    return x.select("symbol", "seq", *[settled(F.col(c), n).alias(c) for c, n in EXTRAS.items()])


@query(VECTOR_SQL + """, e AS (SELECT strategy, seq, ts_ns, row_number() OVER (ORDER BY seq) AS n, CASE WHEN k % 5 <> 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS fill FROM trades) SELECT a.seq, round(sum(0.05 * pow(0.95, a.n - b.n) * b.fill), 8) AS fill_ema FROM e a JOIN e b ON b.n BETWEEN a.n - 599 AND a.n GROUP BY a.seq""")
def execution_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential mean of fills after each order."""
    return executions(trades(spark, sf_dir)).select("seq", F.round("fill_ema", 8).alias("fill_ema"))
