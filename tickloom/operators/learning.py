"""Sequential models: Bayesian regression, Thompson policy, and the simulator that uses them.

A run (symbol, seed, settings) is sequential by nature, as fills change later
decisions. Runs are independent, so the grid of runs is what scales: a run's
quotes stream through its task in order, batch by batch, and only the state
stays in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequential import COLUMNS, simulate_rows
from ..plans.registry import query
from ..sources.views import ticks
from .features import features, regimes, triggers


def simulate(t: DataFrame, runs: list[tuple[str, int, str]]) -> DataFrame:
    """One row for each symbol and run (strategy, seed, mode): every quote is shuffled once and passes all runs of its symbol.

    Modes: ``learning`` from the first quote on; ``cold``, ``warm`` and
    ``frozen`` where ``t`` has a column ``test``: without the quotes before
    the test, learning on them and on, learning on them only. What is counted
    is the test. Triggers, features, limits and executions are those of the
    other operators; a run's own fills feed its features.
    """
    x = triggers(regimes(features(t)))
    test = F.col("test") if "test" in t.columns else F.lit(True)
    x = x.select("symbol", "seq", "ts_ns", "mid", test.alias("test"), "trigger_a", "trigger_b", "trigger_c", *COLUMNS)
    s = x.repartition("symbol").sortWithinPartitions("symbol", "seq")
    return s.mapInPandas(simulate_rows(runs), "symbol string, strategy string, seed bigint, mode string, n_trades bigint, profit double, max_drawdown double, rejected bigint, held bigint, forced bigint")


@query()
def simulate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backtests of all symbols and strategies by seeds; the same seed gives the same result."""
    return simulate(ticks(spark, sf_dir), [(s, seed, "learning") for s in "ABC" for seed in (42, 123, 456)])


@query()
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each third of the data but the first is tested after the third before it, by modes."""
    from ..functions.ordered import numbered

    t = numbered(ticks(spark, sf_dir), ["symbol"])
    size = t.groupBy("symbol").agg(F.max("n").alias("all"))
    t = t.join(size, "symbol").withColumn("third", F.floor((F.col("n") - 1) * 3 / F.col("all")))
    folds = F.array(*[F.when(F.col("third") == k - 1, F.struct(F.lit(k).alias("fold"), F.lit(False).alias("test"))) for k in (1, 2)], *[F.when(F.col("third") == k, F.struct(F.lit(k).alias("fold"), F.lit(True).alias("test"))) for k in (1, 2)])
    t = t.withColumn("f", F.explode(F.array_compact(folds))).withColumns({"symbol": F.concat_ws("#", "symbol", F.col("f.fold").cast("string")), "test": F.col("f.test")}).drop("n", "all", "third", "f")
    return simulate(t, [(s, 42, mode) for s in "ABC" for mode in ("cold", "warm", "frozen")])
