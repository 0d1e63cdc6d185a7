"""Safe mode after a change of provider: smaller orders and wider uncertainty until the new one's estimates have settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import asof, carried_last, ema, haloed, numbered, running, running_max
from ..functions.stored import stored
from ..plans.registry import query, settled, settled_sql
from ..sources.views import trades
from .runtime import LP_ALPHA, LP_FILL, PROVIDERS

#: Share of the lots and factor of the deviation in safe mode; observations it takes at least; its longest time; errors below which estimates have settled.
LOTS, SIGMA, LEAST, LONGEST_NS, SLIPPAGE_ERROR, FILL_ERROR = 0.25, 2.0, 30, 300_000_000_000, 2e-4, 0.1
#: Sequence numbers of a stretch of the as-of join of switches.
REACH = 1 << 20


def switches(t: DataFrame, other: Column, run: int) -> DataFrame:
    """Changes of provider: seq, to_lp, base_fill. A provider is left when it has rejected ``run`` requests in a row; ``other`` is whom orders go to then, with the fill rate it had."""
    x = numbered(t.select("lp_id", "seq", F.col("filled").cast("double").alias("fill"), other.alias("to_lp")), ["lp_id"])
    states = ema(x, ["lp_id"], {"fill_ema": ("fill", LP_FILL)}, LP_ALPHA).select("lp_id", "seq", F.col("seq").alias("at"), "fill_ema")
    w = Window.partitionBy("lp_id", "chunk").orderBy("n")
    h = haloed(x, halo=run + 1).withColumn("bad", F.sum(1 - F.col("fill")).over(w.rowsBetween(1 - run, 0)) >= run)
    h = h.withColumn("onset", F.col("bad") & ~F.coalesce(F.lag("bad").over(w), F.lit(False))).where("own and onset")
    s = asof(h.select("seq", F.col("seq").alias("at"), F.col("to_lp").alias("lp_id")), states, ["fill_ema"], ts="at", stretch=REACH, by=["lp_id"])
    return s.select("seq", F.col("lp_id").alias("to_lp"), F.coalesce("fill_ema", F.lit(LP_FILL)).alias("base_fill"))


def safe_mode(t: DataFrame, least: int = LEAST, longest_ns: int = LONGEST_NS, slippage_error: float = SLIPPAGE_ERROR, fill_error: float = FILL_ERROR) -> DataFrame:
    """Requests in the order of ``seq`` with the state after each: target, observations, safe, lot_factor, sigma_factor, progress.

    ``t`` has lp_id, seq, ts_ns, filled, slippage, predicted (slippage), and
    where the provider changes to_lp and base_fill. A change begins an episode
    and ends the one before. Its observations are the target's requests; it is
    over with the first one at which there are enough of them and either the
    time is up or both errors are small; that of the slippage is compared to
    six places, that of the fill rate to nine, so 0.9 - 0.8 is not below 0.1
    for want of a last bit. Sums are carried over chunks of rows
    within an episode, so an episode may be as long as it likes.
    """
    begins = F.col("to_lp").isNotNull()
    x = running(numbered(t, []), [], {"episode": begins.cast("bigint")})
    x = carried_last(x.withColumn("__switch", F.when(begins, F.struct("to_lp", "base_fill"))), [], "__switch", "__now")
    x = stored(x, "episodes")
    seen = F.coalesce((F.col("lp_id") == F.col("__now.to_lp")) & ~begins, F.lit(False))
    hit = seen & F.col("filled")
    x = x.withColumns({"target": F.col("__now.to_lp"), "__seen": seen, "__early": F.when(seen, -F.col("ts_ns"))})
    x = running(x, ["episode"], {"observations": seen.cast("bigint"), "__fills": hit.cast("bigint"), "__slip": F.when(hit, F.col("slippage")).otherwise(0.0), "__pred": F.when(hit, F.col("predicted")).otherwise(0.0)})
    x = running_max(x, ["episode"], "__early", "__first")
    slip, pred = (F.try_divide(F.col(c), F.col("__fills")) for c in ("__slip", "__pred"))
    apart = F.round(F.abs(slip - pred) / F.greatest(F.abs(slip), F.abs(pred), F.lit(1e-10)), 6)
    misses = F.round(F.abs(F.try_divide("__fills", "observations") - F.col("__now.base_fill")), 9)
    calm = (apart < slippage_error) & (misses < fill_error)
    done = F.col("__seen") & (F.col("observations") >= least) & ((F.col("ts_ns") + F.col("__first") >= longest_ns) | calm)
    x = running_max(x.withColumn("__done", F.coalesce(done, F.lit(False)).cast("int")), ["episode"], "__done", "__over")
    safe = (F.col("episode") > 0) & (F.col("__over") == 0)
    return x.withColumns({
        "safe": safe, "lot_factor": F.when(safe, LOTS).otherwise(1.0), "sigma_factor": F.when(safe, SIGMA).otherwise(1.0),
        "progress": F.when(safe & F.lit(least > 0), F.least(F.col("observations") / max(least, 1), F.lit(1.0))).otherwise(1.0),
    }).select(*t.columns, "episode", "target", "observations", "safe", "lot_factor", "sigma_factor", "progress")


_LONG, _SLIP = 6 * 3_600_000_000_000, 0.2


@query(PROVIDERS + f""", rb AS (SELECT lp_id, seq, sum(CASE WHEN k >= 90 THEN 1 ELSE 0 END) OVER (PARTITION BY lp_id ORDER BY seq ROWS 1 PRECEDING) >= 2 AS bad FROM trades), ro AS (SELECT *, bad AND NOT coalesce(lag(bad) OVER (PARTITION BY lp_id ORDER BY seq), false) AS onset FROM rb),
sg AS (SELECT seq, CASE WHEN lp_id = 'LP_PRIMARY' THEN 'LP_BACKUP' ELSE 'LP_PRIMARY' END AS to_lp FROM ro WHERE onset), sb AS (SELECT sg.seq, sg.to_lp, coalesce(ps.fill_ema, 0.8) AS base FROM sg ASOF LEFT JOIN ps ON sg.to_lp = ps.lp_id AND sg.seq >= ps.seq),
e0 AS (SELECT t.seq, t.ts_ns, t.lp_id, k < 90 AS filled, slippage, slippage + (k % 5 - 2) / CAST(100000 AS DOUBLE) AS predicted, sb.to_lp, sb.base, count(sb.to_lp) OVER (ORDER BY t.seq ROWS UNBOUNDED PRECEDING) AS episode FROM trades t LEFT JOIN sb ON sb.seq = t.seq),
e1 AS (SELECT *, max(to_lp) OVER (PARTITION BY episode) AS target, max(base) OVER (PARTITION BY episode) AS b FROM e0), e2 AS (SELECT *, coalesce(lp_id = target AND to_lp IS NULL, false) AS seen FROM e1),
e3 AS (SELECT *, count(*) FILTER (seen) OVER w AS obs, count(*) FILTER (seen AND filled) OVER w AS fills, sum(CASE WHEN seen AND filled THEN slippage ELSE 0 END) OVER w AS s, sum(CASE WHEN seen AND filled THEN predicted ELSE 0 END) OVER w AS p, min(CASE WHEN seen THEN ts_ns END) OVER w AS first FROM e2 WINDOW w AS (PARTITION BY episode ORDER BY seq ROWS UNBOUNDED PRECEDING)),
e4 AS (SELECT *, CASE WHEN seen AND obs >= {LEAST} AND (ts_ns - first >= {_LONG} OR (fills > 0 AND round(abs(s / fills - p / fills) / greatest(abs(s / fills), abs(p / fills), 1e-10), 6) < {_SLIP} AND round(abs(fills / obs - b), 9) < {FILL_ERROR})) THEN 1 ELSE 0 END AS done FROM e3),
e5 AS (SELECT *, episode > 0 AND max(done) OVER (PARTITION BY episode ORDER BY seq ROWS UNBOUNDED PRECEDING) = 0 AS safe FROM e4)
SELECT seq, lp_id, target, obs AS observations, safe, CASE WHEN safe THEN {LOTS} ELSE 1 END AS lot_factor, CASE WHEN safe THEN {SIGMA} ELSE 1 END AS sigma_factor, {settled_sql(f"CASE WHEN safe THEN least(obs / CAST({LEAST} AS DOUBLE), 1) ELSE 1 END", 6)} AS progress FROM e5""")
def recalibration_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rejections in a row send orders to the other provider; what it shows is compared with its fill rate and predicted slippage. At most six hours, as trades are minutes apart."""
    k = F.col("k")
    t = trades(spark, sf_dir).select("seq", "ts_ns", "lp_id", (k < 90).alias("filled"), "slippage", (F.col("slippage") + (k % 5 - 2) / 100000.0).alias("predicted"))
    s = switches(t, F.when(F.col("lp_id") == "LP_PRIMARY", "LP_BACKUP").otherwise("LP_PRIMARY"), 2)
    x = safe_mode(t.join(s, "seq", "left"), longest_ns=_LONG, slippage_error=_SLIP)
    return x.select("seq", "lp_id", "target", "observations", "safe", "lot_factor", "sigma_factor", settled(F.col("progress"), 6).alias("progress"))
