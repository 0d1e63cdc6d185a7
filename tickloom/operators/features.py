"""Microstructure features of quotes that need no position: windows over chunks of a symbol's quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import carried_max, frame_sums, haloed, numbered, recent
from ..plans.registry import query, settled, settled_sql
from ..sources.views import SQL, ticks, trades

SPREAD_WINDOW, VOL_SHORT, VOL_LONG, EPS = 200, 100, 500, 1e-10
SESSIONS = ("tokyo", "london", "ny", "sydney")
#: Entropy above which a regime is unknown and nothing is traded; divergence that stops a trigger; least scale of a standardised feature.
UNKNOWN, MAX_KL, LEAST_SCALE = 1.8, 1.0, 1.0


def order():
    return Window.partitionBy("symbol").orderBy("seq")


def _hour() -> Column:
    return F.expr("ts_ns div 3600000000000 % 24")


def session() -> Column:
    """Trading session by UTC hour: 0 Tokyo, 1 London, 2 New York, 3 Sydney."""
    h = _hour()
    return F.when(h >= 22, 3).when(h >= 13, 2).when(h >= 8, 1).otherwise(0)


def features(t: DataFrame) -> DataFrame:
    """Quotes with mid, spread, its z-score, order book imbalance and change, depth change, volatilities, session and cost columns."""
    t = numbered(t, ["symbol"]).withColumn("session", session())
    w = Window.partitionBy("symbol", "chunk").orderBy("n")
    x = haloed(t)
    x = x.withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "spread": F.col("ask") - F.col("bid"), "depth": F.col("bid_size") + F.col("ask_size")})
    x = x.withColumn("obi", F.when(F.col("depth") > 0, (F.col("ask_size") - F.col("bid_size")) / F.col("depth")).otherwise(0.0))
    before_mid, before_depth, before_session = (F.lag(c).over(w) for c in ("mid", "depth", "session"))
    new = (F.col("n") == 1) | (before_session != F.col("session"))
    x = x.withColumns({
        "ret": F.when(before_mid.isNotNull(), F.when((before_mid > 0) & (F.col("mid") > 0), F.log(F.col("mid") / before_mid)).otherwise(0.0)),
        "delta_obi": F.col("obi") - F.coalesce(F.lag("obi").over(w), F.col("obi")),
        "depth_change_rate": F.when(before_depth > 0, (F.col("depth") - before_depth) / before_depth).otherwise(0.0), "opens": F.when(new, F.col("ts_ns")),
    })
    x = frame_sums(x, w, {"spread": (SPREAD_WINDOW,), "ret": (VOL_SHORT, VOL_LONG)})
    deviation = lambda c, r, less: F.sqrt(F.col(f"{c}_m2_{r}") / (F.col(f"{c}_count_{r}") - less))
    x = x.withColumn("spread_sd", F.when(F.col(f"spread_count_{SPREAD_WINDOW}") > 1, deviation("spread", SPREAD_WINDOW, 1)))
    x = x.withColumns({
        "spread_z": F.when(F.col("spread_sd") > EPS, (F.col("spread") - F.col(f"spread_mean_{SPREAD_WINDOW}")) / F.col("spread_sd")).otherwise(0.0),
        "rv": F.coalesce(deviation("ret", VOL_SHORT, 0), F.lit(0.0)), "rv_long": F.coalesce(deviation("ret", VOL_LONG, 0), F.lit(0.0)), "opened": F.max("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)),
    })
    before_rv = F.lag("rv").over(w)
    x = x.withColumns({
        "volatility_ratio": F.when(F.col("rv_long") > EPS, F.col("rv") / F.col("rv_long")).otherwise(1.0),
        "volatility_decay": F.when(before_rv > EPS, (F.col("rv") - before_rv) / before_rv).otherwise(0.0),
    })
    # when the session's run began: in this chunk, else the last opening of the chunks before
    order_ = Window.partitionBy("symbol", "chunk").orderBy("n")
    light = haloed(t.select("symbol", "n", "ts_ns", "session"), halo=1)
    light = light.withColumn("opens", F.when((F.col("n") == 1) | (F.lag("session").over(order_) != F.col("session")), F.col("ts_ns"))).where("own")
    x = x.where("own").join(carried_max(light, ["symbol"], "opens"), ["symbol", "chunk"])
    x = x.withColumns({"open_ms": ((F.col("ts_ns") - F.coalesce("opened", "before")) / 1000000).cast("bigint"), "spike_ms": F.lit(86_400_000).cast("bigint")})
    x = x.drop("chunk", "own", "opens", "opened", "before", "spread_sd", "n", *[f"{c}_{k}_{r}" for c, r in (("spread", SPREAD_WINDOW), ("ret", VOL_SHORT), ("ret", VOL_LONG)) for k in ("count", "mean", "m2")])
    one = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    bias = F.element_at(F.array(F.lit(-0.05), F.lit(0.10), F.lit(0.15), F.lit(0.0)), F.col("session") + 1)
    obi, z, vr = F.col("obi"), F.col("spread_z"), F.col("volatility_ratio")
    return x.withColumns({
        "dynamic_cost": F.col("spread") * (1 + 0.5 * F.abs(obi) + 10 * F.col("rv")),
        "p_revert": one(0.4 * one(F.abs(z) / 3) + 0.3 * one(2 * F.abs(obi)) + F.when(F.col("depth_change_rate") < -0.2, 0.3).otherwise(0.0)),
        "p_continue": one(0.6 * one(2 * F.greatest(vr - 1, F.lit(0.0)))), "p_trend": one(0.5 + bias + 0.3 * obi),
        "z_x_rv": z * F.col("rv"), "obi_x_session": obi * F.col("session"), "obi_x_rv": obi * F.col("rv"),
    })


FEATURES = SQL + f""", f0 AS (SELECT *, (bid + ask) / 2 AS mid, ask - bid AS spread, bid_size + ask_size AS depth, CASE WHEN ts_ns // 3600000000000 % 24 >= 22 THEN 3 WHEN ts_ns // 3600000000000 % 24 >= 13 THEN 2 WHEN ts_ns // 3600000000000 % 24 >= 8 THEN 1 ELSE 0 END AS session FROM ticks),
f1 AS (SELECT *, CASE WHEN depth > 0 THEN (ask_size - bid_size) / depth ELSE 0 END AS obi FROM f0),
f2 AS (SELECT *, ln(mid / lag(mid) OVER o) AS ret, obi - coalesce(lag(obi) OVER o, obi) AS delta_obi, CASE WHEN lag(depth) OVER o > 0 THEN (depth - lag(depth) OVER o) / lag(depth) OVER o ELSE 0 END AS depth_change_rate, CASE WHEN session = lag(session) OVER o THEN 0 ELSE 1 END AS new_run FROM f1 WINDOW o AS (PARTITION BY symbol ORDER BY seq)),
f3 AS (SELECT *, CASE WHEN stddev_samp(spread) OVER s > {EPS} THEN (spread - avg(spread) OVER s) / stddev_samp(spread) OVER s ELSE 0 END AS spread_z, coalesce(stddev_pop(ret) OVER a, 0) AS rv, coalesce(stddev_pop(ret) OVER b, 0) AS rv_long, sum(new_run) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM f2
 WINDOW s AS (PARTITION BY symbol ORDER BY seq ROWS 199 PRECEDING), a AS (PARTITION BY symbol ORDER BY seq ROWS 99 PRECEDING), b AS (PARTITION BY symbol ORDER BY seq ROWS 499 PRECEDING)),
f4 AS (SELECT *, CASE WHEN rv_long > {EPS} THEN rv / rv_long ELSE 1 END AS volatility_ratio, CASE WHEN lag(rv) OVER o > {EPS} THEN (rv - lag(rv) OVER o) / lag(rv) OVER o ELSE 0 END AS volatility_decay, (ts_ns - min(ts_ns) OVER (PARTITION BY symbol, run)) // 1000000 AS open_ms FROM f3 WINDOW o AS (PARTITION BY symbol ORDER BY seq)),
f AS (SELECT *, spread * (1 + 0.5 * abs(obi) + 10 * rv) AS dynamic_cost, least(1, 0.4 * least(1, abs(spread_z) / 3) + 0.3 * least(1, 2 * abs(obi)) + CASE WHEN depth_change_rate < -0.2 THEN 0.3 ELSE 0 END) AS p_revert, 0.6 * least(1, 2 * greatest(volatility_ratio - 1, 0)) AS p_continue,
 greatest(0, least(1, 0.5 + [-0.05, 0.10, 0.15, 0.0][session + 1] + 0.3 * obi)) AS p_trend FROM f4)
"""


def _feature_query(name: str, cols: dict[str, int], exact: tuple[str, ...] = (), doc: str = "") -> None:
    sql_cols = ", ".join([f"round(CAST({c} AS DOUBLE), {n}) AS {c}" for c, n in cols.items()] + list(exact))

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return features(ticks(spark, sf_dir)).select("symbol", "seq", *[F.round(c, n).alias(c) for c, n in cols.items()], *[F.col(c).cast("bigint").alias(c) for c in exact])

    f.__name__, f.__doc__ = name, doc
    query(FEATURES + f"SELECT symbol, seq, {sql_cols} FROM f")(f)


_feature_query("mid_spread", {"mid": 9, "spread": 9}, doc="Mid price and spread.")
_feature_query("spread_z", {"spread_z": 5}, doc="Spread against the last 200 quotes.")
_feature_query("obi_delta", {"obi": 9, "delta_obi": 9}, doc="Order book imbalance and its change.")
_feature_query("depth_change", {"depth_change_rate": 9}, doc="Relative change of depth.")
_feature_query("realized_vol_ratio", {"rv": 8, "volatility_ratio": 5}, doc="Volatility of 100 log returns and its ratio to 500.")
_feature_query("session_open_ms", {}, ("session", "open_ms"), doc="Session and time since the contiguous run of it began.")


@query(FEATURES + "SELECT symbol, seq, CAST(session = 0 AS INT) AS tokyo, CAST(session = 1 AS INT) AS london, CAST(session = 2 AS INT) AS ny, CAST(session = 3 AS INT) AS sydney FROM f")
def session_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).select("symbol", "seq", *[(session() == i).cast("int").alias(s) for i, s in enumerate(SESSIONS)])


@query(FEATURES + "SELECT symbol, seq, round(spread_z * rv, 7) AS z_x_rv, round(obi * session, 8) AS obi_x_session, round(obi * rv, 8) AS obi_x_rv FROM f")
def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(ticks(spark, sf_dir)).select("symbol", "seq", F.round("z_x_rv", 7).alias("z_x_rv"), F.round("obi_x_session", 8).alias("obi_x_session"), F.round("obi_x_rv", 8).alias("obi_x_rv"))


def sanitise(c: Column, low: float | None = None, high: float | None = None, cap: float = 0.0) -> Column:
    """Non-finite values become ``cap``, others are clamped."""
    c = c.cast("double")
    x = F.when(F.abs(c) < F.lit(float("inf")), c).otherwise(F.lit(cap))  # NaN exceeds infinity, and null is no yes
    x = F.greatest(x, F.lit(low)) if low is not None else x
    return F.least(x, F.lit(high)) if high is not None else x


@query(SQL + "SELECT seq, CASE WHEN k = 0 THEN 0 ELSE round(greatest(c / CAST(k AS DOUBLE), 0), 9) END AS x, CASE WHEN k = 0 THEN 86400000 ELSE least(greatest(CAST(c AS DOUBLE) * 20000 / k, 0), 86400000) END AS ms FROM (SELECT event_id AS seq, c, k FROM base)")
def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that may be non-finite, made fit for a model."""
    t = trades(spark, sf_dir).withColumn("c", (F.col("pnl_c") + 5000).cast("double"))
    inf = F.lit(float("inf"))
    ratio = F.when(F.col("k") == 0, inf).otherwise(F.col("c") / F.col("k"))
    big = F.when(F.col("k") == 0, inf).otherwise(F.col("c") * 20000 / F.col("k"))
    return t.select("seq", F.round(sanitise(ratio, 0.0), 9).alias("x"), sanitise(big, 0.0, 86_400_000.0, 86_400_000.0).alias("ms"))


@query(SQL + "SELECT strategy, seq, count(*) OVER w AS n_60s, CAST(sum(CASE WHEN direction = 'Buy' THEN lots ELSE -lots END) OVER w AS BIGINT) AS signed_volume FROM trades WINDOW w AS (PARTITION BY strategy ORDER BY ts_ns RANGE BETWEEN 60000000000 PRECEDING AND CURRENT ROW)")
def trade_intensity_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills of the last minute and their signed volume."""
    t = trades(spark, sf_dir).select("strategy", "seq", "ts_ns", F.when(F.col("direction") == "Buy", F.col("lots")).otherwise(-F.col("lots")).alias("signed"))
    x = recent(t.drop("signed"), t, {"n_60s": F.lit(1), "signed_volume": F.col("signed")}, 60_000_000_000, by=["strategy"])
    return x.select("strategy", "seq", F.col("n_60s").cast("bigint").alias("n_60s"), F.col("signed_volume").cast("bigint").alias("signed_volume"))


@query(FEATURES + """, pos AS (SELECT *, (seq % 5 - 2) * 1000 AS pos, seq % 700 AS hold FROM f)
SELECT symbol, seq, round(CASE WHEN bid_size > 0 THEN least(abs(pos) / bid_size, 1) ELSE 0 END, 8) AS queue_position, round(abs(pos) / 1000.0 * rv, 8) AS self_impact, round(CASE WHEN hold <= 0 THEN 1 ELSE exp(-0.01 * hold) END, 8) AS time_decay,
 round(spread_z * obi, 6) AS a_z_obi, round(rv * obi, 8) AS b_rv_obi, """ + settled_sql("obi * least(open_ms / CAST(1000000 AS DOUBLE), 60)", 9) + """ AS c_obi_open FROM pos""")
def position_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue position, self impact, time decay and strategy extras for a given position."""
    x = features(ticks(spark, sf_dir)).withColumns({"pos": (F.col("seq") % 5 - 2) * 1000, "hold": F.col("seq") % 700})
    return x.select(
        "symbol", "seq", F.round(F.when(F.col("bid_size") > 0, F.least(F.abs("pos") / F.col("bid_size"), F.lit(1.0))).otherwise(0.0), 8).alias("queue_position"),
        F.round(F.abs("pos") / 1000.0 * F.col("rv"), 8).alias("self_impact"), F.round(F.when(F.col("hold") <= 0, 1.0).otherwise(F.exp(-0.01 * F.col("hold"))), 8).alias("time_decay"),
        F.round(F.col("spread_z") * F.col("obi"), 6).alias("a_z_obi"), F.round(F.col("rv") * F.col("obi"), 8).alias("b_rv_obi"), settled(F.col("obi") * F.least(F.col("open_ms") / 1000000.0, F.lit(60.0)), 9).alias("c_obi_open"),
    )


#: Centres of the regimes calm, normal, turbulent, crisis in |z|, volatility, volatility ratio; weights of the distances.
CENTRES, DISTANCE = ((0.0, 0.0, 0.0), (1.0, 0.01, 1.0), (2.0, 0.03, 2.0), (3.0, 0.05, 3.0)), (1.0, 10.0, 2.0)
REGIMES = ("p_calm", "p_normal", "p_turbulent", "p_crisis")


def regimes(x: DataFrame) -> DataFrame:
    """Posterior of the four regimes (softmax of how near each is, stabilised), its entropy and its divergence from uniform."""
    at = (F.abs("spread_z"), F.col("rv"), F.col("volatility_ratio"))
    x = x.withColumns({f"__s{i}": -sum((w * F.abs(v - c) for v, c, w in zip(at, centre, DISTANCE, strict=True)), F.lit(0.0)) for i, centre in enumerate(CENTRES)})
    x = x.withColumn("__top", F.greatest(*[f"__s{i}" for i in range(4)]))
    x = x.withColumns({f"__s{i}": F.exp(F.col(f"__s{i}") - F.col("__top")) for i in range(4)})
    x = x.withColumn("__top", F.col("__s0") + F.col("__s1") + F.col("__s2") + F.col("__s3"))
    x = x.withColumns({n: F.col(f"__s{i}") / F.col("__top") for i, n in enumerate(REGIMES)})
    entropy = -sum((F.when(F.col(n) > 0, F.col(n) * F.log(n)).otherwise(0.0) for n in REGIMES), F.lit(0.0))
    kl = sum((F.when(F.col(n) > 1e-12, F.col(n) * F.log(F.col(n) * 4)).otherwise(0.0) for n in REGIMES), F.lit(0.0))
    return x.withColumns({"entropy": entropy, "kl_uniform": kl}).drop("__top", *[f"__s{i}" for i in range(4)])


REGIME = FEATURES + """, g0 AS (SELECT *, -(abs(spread_z) + 10 * rv + 2 * volatility_ratio) AS s0, -(abs(abs(spread_z) - 1) + 10 * abs(rv - 0.01) + 2 * abs(volatility_ratio - 1)) AS s1, -(abs(abs(spread_z) - 2) + 10 * abs(rv - 0.03) + 2 * abs(volatility_ratio - 2)) AS s2, -(abs(abs(spread_z) - 3) + 10 * abs(rv - 0.05) + 2 * abs(volatility_ratio - 3)) AS s3 FROM f),
g1 AS (SELECT *, exp(s0 - greatest(s0, s1, s2, s3)) AS e0, exp(s1 - greatest(s0, s1, s2, s3)) AS e1, exp(s2 - greatest(s0, s1, s2, s3)) AS e2, exp(s3 - greatest(s0, s1, s2, s3)) AS e3 FROM g0),
g2 AS (SELECT *, e0 / (e0 + e1 + e2 + e3) AS p_calm, e1 / (e0 + e1 + e2 + e3) AS p_normal, e2 / (e0 + e1 + e2 + e3) AS p_turbulent, e3 / (e0 + e1 + e2 + e3) AS p_crisis FROM g1),
g AS (SELECT *, -list_sum([CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END for p in [p_calm, p_normal, p_turbulent, p_crisis]]) AS entropy, list_sum([CASE WHEN p > 1e-12 THEN p * ln(p * 4) ELSE 0 END for p in [p_calm, p_normal, p_turbulent, p_crisis]]) AS kl_uniform FROM g2)
"""


@query(REGIME + "SELECT symbol, seq, round(p_calm, 5) AS p_calm, round(p_normal, 5) AS p_normal, round(p_turbulent, 5) AS p_turbulent, round(p_crisis, 5) AS p_crisis, round(entropy, 5) AS entropy, round(kl_uniform, 5) AS kl_uniform, entropy > 1.8 AS unknown FROM g")
def regime_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regime posterior of each quote, and whether it is too even to tell."""
    x = regimes(features(ticks(spark, sf_dir)))
    return x.select("symbol", "seq", *[F.round(c, 5).alias(c) for c in (*REGIMES, "entropy", "kl_uniform")], (F.col("entropy") > UNKNOWN).alias("unknown"))


TRIGGERS = """spread_z > 2 AND depth_change_rate < -0.1 AND volatility_ratio > 2 AND kl_uniform < 1""", """volatility_ratio > 2 AND volatility_decay < 0 AND abs(obi) > 0.1 AND kl_uniform < 1""", """abs(obi) > 0.15 AND open_ms < 1200000 AND kl_uniform < 1"""


def triggers(x: DataFrame) -> DataFrame:
    """Entry rules of the three strategies on quotes with features and regimes."""
    z, vr, obi, sure = F.col("spread_z"), F.col("volatility_ratio"), F.abs("obi"), F.col("kl_uniform") < MAX_KL
    return x.withColumns({
        "trigger_a": (z > 2) & (F.col("depth_change_rate") < -0.1) & (vr > 2) & sure, "trigger_b": (vr > 2) & (F.col("volatility_decay") < 0) & (obi > 0.1) & sure, "trigger_c": (obi > 0.15) & (F.col("open_ms") < 1_200_000) & sure,
    })


@query(REGIME + f"SELECT * FROM (SELECT symbol, seq, {TRIGGERS[0]} AS trigger_a, {TRIGGERS[1]} AS trigger_b, {TRIGGERS[2]} AS trigger_c FROM g) WHERE trigger_a OR trigger_b OR trigger_c")
def triggers_abc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes on which a strategy's entry rule fires."""
    x = triggers(regimes(features(ticks(spark, sf_dir))))
    return x.select("symbol", "seq", "trigger_a", "trigger_b", "trigger_c").where("trigger_a or trigger_b or trigger_c")


@query(FEATURES + """, n AS (SELECT symbol, seq, mid, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM f), m AS (SELECT symbol, avg(mid) AS mu, greatest(stddev_pop(mid), 1.0) AS sd FROM n WHERE i <= greatest(1, least(n - 1, CAST(floor(n * 0.8) AS BIGINT))) GROUP BY symbol)
SELECT n.symbol, seq, i <= greatest(1, least(n - 1, CAST(floor(n * 0.8) AS BIGINT))) AS train, round((mid - mu) / sd, 6) AS z FROM n JOIN m USING (symbol)""")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chronological split and standardisation by the training part's mean and deviation."""
    t = ticks(spark, sf_dir).select("symbol", "seq", ((F.col("bid") + F.col("ask")) / 2).alias("mid"))
    n = t.groupBy("symbol").agg(F.count("*").alias("n"))
    x = numbered(t, ["symbol"]).withColumnRenamed("n", "i").join(n, "symbol").withColumn("train", F.col("i") <= F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(F.col("n") * 0.8))))
    m = x.where("train").groupBy("symbol").agg(F.avg("mid").alias("mu"), F.greatest(F.stddev_pop("mid"), F.lit(LEAST_SCALE)).alias("sd"))
    return x.join(m, "symbol").select("symbol", "seq", "train", F.round((F.col("mid") - F.col("mu")) / F.col("sd"), 6).alias("z"))
