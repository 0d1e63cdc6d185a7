"""Positions at average cost, their value as of each quote, profit of periods, and the life of strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import asof, carried_last, frame_sums, haloed, numbered, running, scan
from ..functions.stored import stored
from ..plans.registry import query, settled, settled_sql
from ..sources.views import SQL, ticks, trades
from .risk import DAILY_C, DAILY_MTM_C, MONTHLY_C, WEEKLY_C, ZONE, period_profit, periods

STRATEGIES = ("A", "B", "C")


def fills(t: DataFrame) -> DataFrame:
    """Trades as signed fills: strategy, seq, ts_ns, size, price."""
    side = F.when(F.col("direction") == "Buy", 1.0).otherwise(-1.0)
    return t.select("strategy", "seq", "ts_ns", (side * (1 + F.col("seq") % 3)).alias("size"), (F.lit(100.0) + F.col("pnl_c") / 10000.0).alias("price"))


def average_cost(f: DataFrame, keys: list[str]) -> DataFrame:
    """Fills (size, price), numbered within their key, with position, entry and realized after each.

    A fill that adds moves the entry to the weighted mean, one against the
    position realises its part at the entry, a flip keeps the old entry. So
    a fill takes the entry e to m e + a, with m and a from the running position
    alone; such steps compose.
    """
    x = running(f, keys, {"position": F.col("size")})
    was, size = F.col("position") - F.col("size"), F.col("size")
    adds, whole = was * size > 0, F.abs(was) + F.abs(size)
    m = F.when(was == 0, 0.0).when(adds, F.abs(was) / whole).when(F.col("position") == 0, 0.0).otherwise(1.0)
    a = F.when(was == 0, F.col("price")).when(adds, F.col("price") * F.abs(size) / whole).otherwise(0.0)
    step = F.when(size == 0, F.struct(F.lit(1.0).alias("m"), F.lit(0.0).alias("a"))).otherwise(F.struct(m.alias("m"), a.alias("a")))
    then = lambda f, g: F.struct((g["m"] * f["m"]).alias("m"), (g["m"] * f["a"] + g["a"]).alias("a"))
    x = scan(x, keys, step, then, lambda e, f: f["m"] * e + f["a"], F.lit(0.0))
    part = F.when(was * size < 0, F.least(F.abs(size), F.abs(was)) * (F.col("price") - F.col("before")) * F.signum(was)).otherwise(0.0)
    return running(x, keys, {"realized": part}).withColumnRenamed("after", "entry").drop("before")


#: Fills, and the state after each by recursion.
COST = SQL.replace("WITH base", "WITH RECURSIVE base", 1) + """, f AS MATERIALIZED (SELECT strategy, seq, ts_ns, CASE WHEN direction = 'Buy' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * (1 + seq % 3) AS size, 100 + pnl_c / CAST(10000 AS DOUBLE) AS price, row_number() OVER (PARTITION BY strategy ORDER BY ts_ns, seq) AS i FROM trades),
c AS (SELECT DISTINCT strategy, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS ts_ns, CAST(0 AS DOUBLE) AS position, CAST(0 AS DOUBLE) AS entry, CAST(0 AS DOUBLE) AS realized FROM f
 UNION ALL SELECT f.strategy, f.i, f.seq, f.ts_ns, position + size, CASE WHEN position = 0 THEN price WHEN position * size > 0 THEN (entry * abs(position) + price * abs(size)) / (abs(position) + abs(size)) WHEN position + size = 0 THEN 0 ELSE entry END,
  realized + CASE WHEN position * size < 0 THEN least(abs(size), abs(position)) * (price - entry) * sign(position) ELSE 0 END FROM c JOIN f ON f.strategy = c.strategy AND f.i = c.i + 1),
held AS (SELECT * FROM c WHERE i > 0)
"""


@query(COST + f"SELECT strategy, seq, position, {settled_sql('entry', 7)} AS entry, {settled_sql('realized', 7)} AS realized FROM held")
def projector_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions at average cost from fills in order."""
    x = average_cost(numbered(fills(trades(spark, sf_dir)), ["strategy"]), ["strategy"])
    return x.select("strategy", "seq", "position", settled(F.col("entry"), 7).alias("entry"), settled(F.col("realized"), 7).alias("realized"))


def valued(quotes: DataFrame, states: DataFrame, names: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """Each quote with the state of each strategy as of it: position, entry, realized (0 before its first fill) and unrealized at the mid price."""
    q = quotes.select("symbol", "seq", "ts_ns", ((F.col("bid") + F.col("ask")) / 2).alias("mid"), F.explode(F.array(*map(F.lit, names))).alias("strategy"))
    x = asof(q, stored(states.select("strategy", "seq", "ts_ns", "position", "entry", "realized"), "states"), ["position", "entry", "realized"], by=["strategy"])
    x = x.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("position", "entry", "realized")})
    return x.withColumn("unrealized", F.col("position") * (F.col("mid") - F.col("entry")))


VALUED = COST + """, q AS (SELECT symbol, seq, ts_ns, (bid + ask) / 2 AS mid, strategy FROM ticks, (SELECT unnest(['A', 'B', 'C']) AS strategy)),
val AS (SELECT q.symbol, q.seq, q.ts_ns, q.strategy, coalesce(position, 0) AS position, coalesce(entry, 0) AS entry, coalesce(realized, 0) AS realized, coalesce(position * (mid - entry), 0) AS unrealized FROM q ASOF LEFT JOIN held h ON h.strategy = q.strategy AND q.ts_ns >= h.ts_ns)
"""


@query(VALUED + f"SELECT symbol, seq, strategy, position, {', '.join(f'{settled_sql(c, 7)} AS {c}' for c in ('entry', 'realized', 'unrealized'))} FROM val")
def asof_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, equity and unrealised profit of all strategies as of each quote."""
    s = average_cost(numbered(fills(trades(spark, sf_dir)), ["strategy"]), ["strategy"])
    return valued(ticks(spark, sf_dir), s).select("symbol", "seq", "strategy", "position", *[settled(F.col(c), 7).alias(c) for c in ("entry", "realized", "unrealized")])


def period_value(x: DataFrame) -> DataFrame:
    """Valued quotes summed over strategies: realized and unrealized, profit since the first quote of the day, the week and the month by the trading day's zone, and the day's with what is open.

    What a period begins with is an aggregate of its quotes, combined before
    the shuffle, so no task sorts a period.
    """
    keys = ["symbol", "seq", "ts_ns"]
    total = stored(periods(x.groupBy(*keys).agg(F.sum("realized").alias("realized"), F.sum("unrealized").alias("unrealized"))), "valued")
    out = total
    for p in ("day", "week", "month"):
        begun = total.groupBy("symbol", p).agg(F.min_by("realized", F.struct("ts_ns", "seq")).alias(f"{p}_start"))
        out = out.join(begun, ["symbol", p]).withColumn(f"{p}_realized", F.col("realized") - F.col(f"{p}_start"))
    return out.withColumn("day_mtm", F.col("day_realized") + F.col("unrealized"))


#: The limits in units of the positions above, a thousandth of the limits in cents.
LIMITS = {"day_mtm": DAILY_MTM_C / 1000, "day_realized": DAILY_C / 1000, "week_realized": WEEKLY_C / 1000, "month_realized": MONTHLY_C / 1000}


@query(VALUED + f""", t AS (SELECT symbol, seq, ts_ns, sum(realized) AS realized, sum(unrealized) AS unrealized FROM val GROUP BY ALL), lt AS (SELECT *, make_timestamp(ts_ns // 1000) AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}' AS loc FROM t),
pk AS (SELECT *, strftime(loc, '%Y-%m-%d') AS day, isoyear(loc) * 100 + weekofyear(loc) AS week, strftime(loc, '%Y-%m') AS month FROM lt),
p AS (SELECT symbol, seq, unrealized, {', '.join(f"realized - first_value(realized) OVER (PARTITION BY symbol, {k} ORDER BY ts_ns, seq) AS {k}_realized" for k in ("day", "week", "month"))} FROM pk), m AS (SELECT *, day_realized + unrealized AS day_mtm FROM p)
SELECT symbol, seq, {', '.join(f'{settled_sql(c, 6)} AS {c}' for c in LIMITS)}, {', '.join(f'{settled_sql(c, 6)} < {v} AS {c}_passed' for c, v in LIMITS.items())} FROM m""")
def period_mtm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profit to date of the day, week and month at each quote, the day's with unrealised profit, against the limits."""
    s = average_cost(numbered(fills(trades(spark, sf_dir)), ["strategy"]), ["strategy"])
    x = period_value(valued(ticks(spark, sf_dir), s)).select("symbol", "seq", *[settled(F.col(c), 6).alias(c) for c in LIMITS])
    return x.withColumns({f"{c}_passed": F.col(c) < v for c, v in LIMITS.items()})


def lives(t: DataFrame, threshold: float = -1.0, yearly: float = 252.0, episodes: int = 100, window: int = 50, row: int = 5, strict: float = 1.5, share: float = 0.5) -> DataFrame:
    """The lives of strategies: from birth or revival to culling, and what culling orders.

    ``t``: trades with strategy, ts_ns, seq, pnl_c, size (signed), regime,
    unknown (that it is an unknown regime), week and day_pnl_c. With at least
    ``episodes`` trades in its life a strategy dies of the last of ``row`` poor
    rolling Sharpe ratios in a row, or of a loss within the regime, since the
    life's begin, of more than a share of the day's profit or loss. It revives
    with its first trade of a later week; all counts begin anew then.

    What a life's end depends on is where it begins, and lives begin at weeks
    only. So each possible begin gets the end that it would lead to, from rows
    marked once for all begins, and a fold over a strategy's weeks follows the
    begins that happen. ``episodes`` must be no less than ``window``, as a
    ratio then never reaches back before its life.
    """
    if episodes < window:
        raise ValueError("a rolling ratio would reach back before a life's begin")
    by = ["strategy"]
    x = numbered(t, by, seq="ts_ns", bucket=1 << 44)
    x = running(x, by, {"sum_c": F.col("pnl_c"), "position": F.col("size")})
    h = haloed(x, halo=window + row + 1)
    w = Window.partitionBy(*by, "chunk").orderBy("n")
    h = frame_sums(h, w, "pnl_c", (window,))
    deviation = F.sqrt(F.col(f"pnl_c_m2_{window}") / (window - 1))
    sharpe = F.col(f"pnl_c_mean_{window}") / F.greatest(deviation, F.lit(1e-10)) * F.sqrt(F.lit(yearly))
    poor = (F.col("n") >= window) & (sharpe < F.when(F.col("unknown"), threshold * strict).otherwise(threshold))
    first = F.lag("regime").over(w).isNull() | (F.lag("regime").over(w) != F.col("regime"))
    monday = F.lag("week").over(w).isNull() | (F.lag("week").over(w) != F.col("week"))
    h = h.withColumns({"poor": poor.cast("int"), "first": first, "monday": monday})
    h = h.withColumn("ill", F.sum("poor").over(w.rowsBetween(1 - row, 0)) == row).where("own").drop("chunk", "own")
    h = h.withColumns({"first": F.col("first") | (F.col("n") == 1), "monday": F.col("monday") | (F.col("n") == 1)})
    h = h.withColumn("mark", F.when(F.col("first"), F.struct(F.col("n").alias("n"), (F.col("sum_c") - F.col("pnl_c")).alias("sum"))))
    h = stored(carried_last(h, by, "mark", "regime_at"), "lives")
    least = F.when(F.col("day_pnl_c") != 0, -F.abs("day_pnl_c") * share)
    begins = h.where("monday").select(*by, F.col("n").alias("begin"), (F.col("sum_c") - F.col("pnl_c")).alias("sum"))
    weeks = begins.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("begin", "sum"))).alias("weeks"))  # one for each week of the data

    # rows that end a life, and the latest begin for which they do
    ready = F.col("n") - episodes + 1
    ill = h.where("ill").select(*by, "n", (ready - row + 1).alias("latest"), F.lit(0).alias("kind"))
    lossy = h.where(F.col("sum_c") - F.col("regime_at.sum") < least).select(*by, "n", F.least(F.col("regime_at.n"), ready).alias("latest"), F.lit(1).alias("kind"))
    marked = ill.union(lossy).where("latest >= 1").join(F.broadcast(weeks), by)
    at = F.size(F.filter("weeks", lambda r: r["begin"] <= F.col("latest")))
    ends = marked.where(at > 0).groupBy(*by, F.element_at("weeks", at)["begin"].alias("begin")).agg(F.min(F.struct("n", "kind")).alias("end"))
    ahead = Window.partitionBy(*by).orderBy("begin").rowsBetween(0, Window.unboundedFollowing)
    ends = begins.join(ends, [*by, "begin"], "left").select(*by, "begin", F.min("end").over(ahead).alias("end"))
    # rows of the regime in which a life begins: its loss counts from the begin
    early = h.where(F.col("regime_at.n") < ready).join(F.broadcast(weeks), by)
    early = early.select(*by, "n", "sum_c", least.alias("least"), F.explode(F.filter("weeks", lambda r: (r["begin"] > F.col("regime_at.n")) & (r["begin"] <= ready))).alias("r"))
    early = early.where(F.col("sum_c") - F.col("r.sum") < F.col("least")).groupBy(*by, F.col("r.begin").alias("begin")).agg(F.min(F.struct("n", F.lit(1).alias("kind"))).alias("soon"))
    ends = ends.join(early, [*by, "begin"], "left").select(*by, "begin", F.array_min(F.array_compact(F.array("end", "soon"))).alias("end"))

    # the begins that happen
    none = F.array().cast("array<struct<begin: bigint, end: struct<n: bigint, kind: int>>>")
    alive = lambda acc, r: (F.size(acc) > 0) & F.coalesce(F.element_at(acc, -1)["end"]["n"] >= r["begin"], F.lit(True))
    chain = F.aggregate("all", none, lambda acc, r: F.when(alive(acc, r), acc).otherwise(F.array_append(acc, r)))
    lived = ends.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("begin").cast("bigint").alias("begin"), F.struct(F.col("end.n").cast("bigint").alias("n"), F.col("end.kind").alias("kind")).alias("end")))).alias("all"))
    lived = lived.select(*by, F.posexplode(chain).alias("life", "c"))
    lived = lived.select(*by, (F.col("life") + 1).cast("bigint").alias("life"), F.col("c.begin").alias("begin"), F.col("c.end.n").alias("n"), F.col("c.end.kind").alias("kind"))
    last = h.select(*by, "n", F.col("seq").alias("dead_seq"), "position")
    born = h.where("monday").select(*by, F.col("n").alias("begin"), F.col("seq").alias("born_seq"))
    out = lived.join(born, [*by, "begin"]).join(last, [*by, "n"], "left")
    close = F.when(F.col("position") > 0, "Sell").when(F.col("position") < 0, "Buy")
    return out.select(
        *by, "life", "born_seq", "dead_seq", (F.col("n") - F.col("begin") + 1).alias("episodes"),
        F.when(F.col("kind") == 0, "low_sharpe").when(F.col("kind") == 1, "regime_loss").alias("reason"),
        F.when(F.col("n").isNotNull(), close).alias("close_direction"), F.when(F.col("position") != 0, F.abs("position").cast("bigint")).alias("close_lots"),
    )


@query(SQL.replace("WITH base", "WITH RECURSIVE base", 1) + f""", lt AS (SELECT *, make_timestamp(ts_ns // 1000) AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}' AS loc FROM trades),
pk AS (SELECT *, strftime(loc, '%Y-%m-%d') AS day, isoyear(loc) * 100 + weekofyear(loc) AS week, seq // 400 % 4 AS regime FROM lt),
w AS (SELECT strategy, seq, ts_ns, pnl_c, week, regime, regime = 3 AS unknown, CASE WHEN direction = 'Buy' THEN 1 ELSE -1 END * (1 + seq % 3) AS size, row_number() OVER o AS i, sum(pnl_c) OVER (PARTITION BY strategy, day ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS day_c, avg(pnl_c) OVER r / greatest(stddev_samp(pnl_c) OVER r, 1e-10) AS s,
 lag(week) OVER o AS week0, lag(regime) OVER o AS regime0 FROM pk WINDOW o AS (PARTITION BY strategy ORDER BY ts_ns, seq), r AS (PARTITION BY strategy ORDER BY ts_ns, seq ROWS 49 PRECEDING)),
f AS MATERIALIZED (SELECT strategy, seq, i, pnl_c, sum(size) OVER (PARTITION BY strategy ORDER BY i ROWS UNBOUNDED PRECEDING) AS position, coalesce(week <> week0, true) AS monday, coalesce(regime <> regime0, true) AS change, s < CASE WHEN unknown THEN -0.075 ELSE -0.05 END AS poor, CASE WHEN day_c <> 0 THEN -abs(day_c) * 2.0 END AS least FROM w),
a AS (SELECT DISTINCT strategy, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS life, CAST(NULL AS BIGINT) AS born, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS run, CAST(0 AS HUGEINT) AS loss, 'dead' AS state, CAST(0 AS BIGINT) AS seq, CAST(0 AS HUGEINT) AS position FROM f
 UNION ALL SELECT strategy, i, life, born, n, run, loss, CASE WHEN state <> 'alive' THEN 'dead' WHEN n >= 100 AND run >= 5 THEN 'low_sharpe' WHEN n >= 100 AND loss < least THEN 'regime_loss' ELSE 'alive' END, seq, position FROM (
  SELECT strategy, i, life, born, n, loss, state, least, seq, position, CASE WHEN n < 100 OR NOT poor THEN 0 ELSE run + 1 END AS run FROM (
   SELECT f.strategy, f.i, f.least, f.poor, f.seq, f.position, CASE WHEN b THEN life + 1 ELSE life END AS life, CASE WHEN b THEN f.seq ELSE born END AS born, CASE WHEN b THEN 1 ELSE n + 1 END AS n, CASE WHEN b THEN 0 ELSE run END AS run, CASE WHEN b OR change THEN 0 ELSE loss END + pnl_c AS loss, CASE WHEN b THEN 'alive' WHEN state = 'alive' THEN state ELSE 'dead' END AS state
   FROM (SELECT a.strategy, a.i, a.life, a.born, a.n, a.run, a.loss, a.state FROM a) a JOIN f ON f.strategy = a.strategy AND f.i = a.i + 1, LATERAL (SELECT f.monday AND a.state <> 'alive' AS b)))),
e AS (SELECT strategy, life, born, max(CASE WHEN state NOT IN ('alive', 'dead') THEN i END) AS i FROM a WHERE i > 0 GROUP BY ALL)
SELECT e.strategy, e.life, e.born AS born_seq, a.seq AS dead_seq, a.n AS episodes, a.state AS reason, CASE WHEN a.position > 0 THEN 'Sell' WHEN a.position < 0 THEN 'Buy' END AS close_direction, CASE WHEN a.position <> 0 THEN CAST(abs(a.position) AS BIGINT) END AS close_lots FROM e LEFT JOIN a ON a.strategy = e.strategy AND a.i = e.i""")
def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lives of strategies, by thresholds that these trades can reach: culling by rolling ratio or regime loss, the order that closes what is open, revival at the next week."""
    t = period_profit(trades(spark, sf_dir))
    regime = F.expr("seq div 400") % 4
    t = t.select("strategy", "seq", "ts_ns", "pnl_c", "week", "day_pnl_c", (F.when(F.col("direction") == "Buy", 1).otherwise(-1) * (1 + F.col("seq") % 3)).alias("size"), regime.alias("regime"), (regime == 3).alias("unknown"))
    return lives(t, threshold=-0.05, yearly=1.0, share=2.0)
