"""Statistical validation of return series: purged cross-validation, overfitting, deflated Sharpe, leakage, sensitivity."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.ordered import lagged, numbered, tiled
from ..functions.stored import stored
from ..plans.registry import query
from ..sources.views import SQL, returns

GROUPS, TEST, PURGE, EMBARGO = 6, 2, 10, 5


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    """Standard normal distribution function."""
    return x.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)) if v == v else None)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The return series, written once, with their row numbers ``n`` (those of ``returns`` have no gaps)."""
    return stored(returns(spark, sf_dir), "returns").withColumn("n", F.col("obs"))


def zones(r: DataFrame, groups: int = GROUPS, gap: int = PURGE + EMBARGO) -> DataFrame:
    """Observations with their group ``grp`` and ``near``, the groups that they are within ``gap`` of.

    Groups are contiguous and as equal as can be. What is known of a strategy's
    groups is one row, which goes to the observations.
    """
    g = tiled(r if "n" in r.columns else numbered(r, ["strategy"], "obs"), ["strategy"], groups, "grp").drop("n")
    bounds = g.groupBy("strategy", "grp").agg(F.min("obs").alias("a"), F.max("obs").alias("b"))
    per = bounds.groupBy("strategy").agg(F.map_from_entries(F.collect_list(F.struct("grp", F.struct("a", "b")))).alias("at"))  # one entry for each group
    near = F.filter(F.sequence(F.lit(1), F.lit(groups)), lambda t: (F.col("obs") >= F.col("at")[t]["a"] - gap) & (F.col("obs") <= F.col("at")[t]["b"] + gap))
    return g.join(F.broadcast(per), "strategy").withColumn("near", near).drop("at")


def dealt(x: DataFrame, groups: int = GROUPS, test: int = TEST) -> DataFrame:
    """Each row of ``zones``, or sums of them by group and ``near``, once for each split (all choices of test groups) with its role: test, purged (near a test group) or train."""
    chosen = [(i, own, list(c)) for i, c in enumerate(combinations(range(1, groups + 1), test)) for own in range(1, groups + 1)]
    plan = x.sparkSession.createDataFrame(chosen, "split int, grp int, tests array<int>")
    role = F.when(F.array_contains("tests", F.col("grp")), "test").when(F.arrays_overlap("tests", "near"), "purged").otherwise("train")
    return x.join(F.broadcast(plan), "grp").withColumn("role", role).drop("tests")


def splits(r: DataFrame, groups: int = GROUPS, test: int = TEST, gap: int = PURGE + EMBARGO) -> DataFrame:
    """Each observation's role in each split: as many rows as observations times splits."""
    return dealt(zones(r, groups, gap), groups, test).select("strategy", "split", "obs", "ret", "role")


def split_sums(r: DataFrame, groups: int = GROUPS, test: int = TEST, gap: int = PURGE + EMBARGO) -> DataFrame:
    """(strategy, split, role) in parts with n, sum_obs, and k, mean and m2 (sum of squares about the mean) of the known returns.

    Observations are added up by group and ``near`` before they meet the
    splits, so none of them is copied.
    """
    k = F.count("ret")
    x = zones(r, groups, gap).groupBy("strategy", "grp", "near").agg(F.count("*").alias("n"), F.sum("obs").alias("sum_obs"), k.alias("k"), F.avg("ret").alias("mean"), (F.var_pop("ret") * k).alias("m2"))
    return dealt(x, groups, test)


SPLITS = SQL + f""", g AS (SELECT *, ntile({GROUPS}) OVER (PARTITION BY strategy ORDER BY obs) AS grp FROM rets), bd AS (SELECT strategy, grp, min(obs) AS a, max(obs) AS b FROM g GROUP BY ALL),
cb AS (SELECT row_number() OVER (ORDER BY x, y) - 1 AS split, x, y FROM range(1, {GROUPS + 1}) t(x), range(1, {GROUPS + 1}) u(y) WHERE x < y),
sp AS (SELECT g.strategy, split, obs, ret, CASE WHEN g.grp IN (x, y) THEN 'test' WHEN obs BETWEEN p.a - {PURGE + EMBARGO} AND p.b + {PURGE + EMBARGO} OR obs BETWEEN q.a - {PURGE + EMBARGO} AND q.b + {PURGE + EMBARGO} THEN 'purged' ELSE 'train' END AS role
 FROM g CROSS JOIN cb JOIN bd p ON p.strategy = g.strategy AND p.grp = x JOIN bd q ON q.strategy = g.strategy AND q.grp = y)
"""


@query(SPLITS + "SELECT strategy, CAST(split AS INT) AS split, role, count(*) AS n, CAST(sum(obs) AS BIGINT) AS sum_obs FROM sp GROUP BY ALL")
def cpcv_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sums(series(spark, sf_dir)).groupBy("strategy", "split", "role").agg(F.sum("n").alias("n"), F.sum("sum_obs").cast("bigint").alias("sum_obs"))


def scores(r: DataFrame) -> DataFrame:
    """Sharpe of each strategy, split and role."""
    own = Window.partitionBy("strategy", "split", "role")  # a few parts
    x = split_sums(r).where("role <> 'purged'").withColumn("all", F.sum(F.col("k") * F.col("mean")).over(own) / F.sum("k").over(own))
    x = x.groupBy("strategy", "split", "role", "all").agg(F.sum("k").alias("k"), F.sum(F.col("m2") + F.col("k") * (F.col("mean") - F.col("all")) ** 2).alias("m2"))
    sd = F.sqrt(F.try_divide(F.col("m2"), F.col("k") - 1))
    return x.select("strategy", "split", "role", F.when(sd > 1e-12, F.col("all") / sd).otherwise(0.0).alias("sharpe"))


SCORES = SPLITS + ", sc AS (SELECT strategy, split, role, CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) ELSE 0 END AS sharpe FROM sp WHERE role <> 'purged' GROUP BY ALL)\n"


@query(SCORES + "SELECT strategy, round(avg(sharpe), 8) AS mean, round(stddev_samp(sharpe), 8) AS std, round(min(sharpe), 8) AS low, round(max(sharpe), 8) AS high, round(avg(CASE WHEN sharpe <= 0 THEN 1.0 ELSE 0.0 END), 8) AS failure_rate FROM sc WHERE role = 'test' GROUP BY strategy")
def cpcv_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_scores(scores(series(spark, sf_dir)))


def fold_scores(sharpes: DataFrame) -> DataFrame:
    """How the Sharpes of a strategy's test parts lie."""
    s = F.col("sharpe")
    return sharpes.where("role = 'test'").groupBy("strategy").agg(
        F.round(F.avg(s), 8).alias("mean"), F.round(F.stddev_samp(s), 8).alias("std"), F.round(F.min(s), 8).alias("low"), F.round(F.max(s), 8).alias("high"), F.round(F.avg(F.when(s <= 0, 1.0).otherwise(0.0)), 8).alias("failure_rate")
    )


@query(SCORES + """, tr AS (SELECT split, strategy, row_number() OVER (PARTITION BY split ORDER BY sharpe DESC, strategy) AS i FROM sc WHERE role = 'train'), te AS (SELECT split, strategy, row_number() OVER (PARTITION BY split ORDER BY sharpe DESC, strategy) - 1 AS rank FROM sc WHERE role = 'test')
SELECT count(*) AS splits, round(avg(CASE WHEN rank >= 1 THEN 1.0 ELSE 0.0 END), 8) AS pbo, avg(CASE WHEN rank >= 1 THEN 1.0 ELSE 0.0 END) <= 0.1 AS passed FROM tr JOIN te USING (split, strategy) WHERE i = 1""")
def pbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of backtest overfitting: how often the best in training is in the lower half of the test ranks."""
    return overfitting(scores(series(spark, sf_dir)))


def overfitting(s: DataFrame) -> DataFrame:
    """The same of given Sharpes (strategy, split, role, sharpe)."""
    rank = F.row_number().over(Window.partitionBy("split").orderBy(F.desc("sharpe"), "strategy"))
    best = s.where("role = 'train'").withColumn("i", rank).where("i = 1").select("split", "strategy")
    te = s.where("role = 'test'").select("split", "strategy", (rank - 1).alias("rank"))
    low = F.avg(F.when(F.col("rank") >= 3 // 2, 1.0).otherwise(0.0))
    return best.join(te, ["split", "strategy"]).agg(F.count("*").alias("splits"), F.round(low, 8).alias("pbo"), (low <= 0.1).alias("passed"))


def moments(r: DataFrame) -> DataFrame:
    """Mean, sample deviation, skewness and excess kurtosis by the sample deviation's powers."""
    m = r.groupBy("strategy").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"))
    x = r.select("strategy", "ret").join(F.broadcast(m), "strategy")  # a row for each strategy
    z = F.when(F.col("sd") > 1e-12, F.try_divide(F.col("ret") - F.col("mean"), F.col("sd"))).otherwise(0.0)
    return x.groupBy("strategy", "n", "mean", "sd").agg(F.avg(z * z * z).alias("skew"), (F.avg(z * z * z * z) - 3).alias("kurtosis"))


MOMENTS = SQL + """, mm AS (SELECT strategy, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd FROM rets GROUP BY strategy),
mo AS (SELECT r.strategy, n, mean, sd, avg(pow((ret - mean) / sd, 3)) AS skew, avg(pow((ret - mean) / sd, 4)) - 3 AS kurtosis FROM rets r JOIN mm USING (strategy) GROUP BY ALL),
ds AS (SELECT *, mean / sd AS sr, greatest((1 - skew * mean / sd + (kurtosis - 1) / 4 * pow(mean / sd, 2)) / (n - 1), 1e-12) AS v FROM mo)
"""


@query(MOMENTS + "SELECT strategy, n, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, round(sr, 8) AS sr, round(sr * sqrt(n) / sqrt(v), 4) AS z FROM ds")
def dsr_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deflated(returns(spark, sf_dir)).select("strategy", "n", F.round("skew", 6).alias("skew"), F.round("kurtosis", 6).alias("kurtosis"), F.round("sr", 8).alias("sr"), F.round("z", 4).alias("z"))


def deflated(r: DataFrame) -> DataFrame:
    """Sharpe ratio with the z-value of its deflated form."""
    m = moments(r).withColumn("sr", F.when(F.col("sd") > 1e-12, F.try_divide("mean", "sd")).otherwise(0.0))
    v = F.greatest((1 - F.col("skew") * F.col("sr") + (F.col("kurtosis") - 1) / 4 * F.col("sr") ** 2) / (F.col("n") - 1), F.lit(1e-12))
    return m.withColumn("z", F.col("sr") * F.sqrt("n") / F.sqrt(v))


#: The normal distribution function by Simpson's rule over 2,000 steps.
DEFLATED = MOMENTS + """, nz AS (SELECT strategy, greatest(-8, least(8, sr * sqrt(n) / sqrt(v))) AS z FROM ds),
np AS (SELECT strategy, 0.5 + z / 6000 / sqrt(2 * pi()) * list_sum(list_transform(range(2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z * i / 2000, 2) / 2))) AS p FROM nz),
nd AS (SELECT strategy, p, exp(ln(greatest(p, 1e-15)) + 9 * ln(greatest(1 - p, 1e-15))) AS dsr FROM np)
SELECT strategy, round(p, 8) AS p, round(dsr, 8) AS dsr, dsr >= 0.95 AS passed FROM nd"""


@query(DEFLATED)
def dsr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deflated Sharpe ratio over ten trials."""
    return deflation(returns(spark, sf_dir))


def deflation(r: DataFrame) -> DataFrame:
    """The same of given series."""
    p = normal_cdf(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), F.col("z"))))
    x = deflated(r).select("strategy", "z", p.alias("p"))
    d = F.exp(F.log(F.greatest(F.col("p"), F.lit(1e-15))) + 9 * F.log(F.greatest(1 - F.col("p"), F.lit(1e-15))))
    return x.select("strategy", F.round("p", 8).alias("p"), F.round(d, 8).alias("dsr"), (d >= 0.95).alias("passed"))


YEARLY = "round(CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END, 7)"


def _yearly(c: str = "ret"):
    sd = F.stddev_samp(c)
    return F.when(sd > 1e-12, F.avg(c) / sd * F.sqrt(F.lit(252.0))).otherwise(0.0)


@query(SQL + f"SELECT strategy, {YEARLY} AS sharpe, {YEARLY} <= 1.5 AS passed, round({YEARLY} / sqrt(38), 6) AS adjusted, {YEARLY} / sqrt(38) > 0 OR {YEARLY} <= 0 AS complexity_passed FROM rets GROUP BY strategy")
def sharpe_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A yearly Sharpe that is too good fails; the complexity penalty divides by the root of the features."""
    return ceilings(returns(spark, sf_dir))


def ceilings(r: DataFrame) -> DataFrame:
    """The same of given series."""
    s = F.round(_yearly(), 7)
    a = s / F.sqrt(F.lit(38.0))
    return r.groupBy("strategy").agg(s.alias("sharpe"), (s <= 1.5).alias("passed"), F.round(a, 6).alias("adjusted"), ((a > 0) | (s <= 0)).alias("complexity_passed"))


@query(SQL + """, h AS (SELECT strategy, ntile(2) OVER (PARTITION BY strategy ORDER BY obs) AS half, ret FROM rets), s AS (SELECT strategy, half, avg(ret) / stddev_samp(ret) AS s FROM h GROUP BY ALL)
SELECT a.strategy, round(CASE WHEN abs(a.s) < 1e-12 THEN 0 ELSE greatest(0, (a.s - b.s) / abs(a.s)) END, 6) AS degradation, CASE WHEN abs(a.s) < 1e-12 THEN 0 ELSE greatest(0, (a.s - b.s) / abs(a.s)) END <= 0.3 AS passed FROM s a JOIN s b USING (strategy) WHERE a.half = 1 AND b.half = 2""")
def degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of Sharpe from the first half to the second."""
    return degraded(series(spark, sf_dir))


def degraded(r: DataFrame) -> DataFrame:
    """The same of given numbered series."""
    h = tiled(r, ["strategy"], 2, "half")
    s = lambda i: F.avg(F.when(F.col("half") == i, F.col("ret"))) / F.stddev_samp(F.when(F.col("half") == i, F.col("ret")))
    x = h.groupBy("strategy").agg(s(1).alias("a"), s(2).alias("b"))
    d = F.when(F.abs("a") < 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), (F.col("a") - F.col("b")) / F.abs("a")))
    return x.select("strategy", F.round(d, 6).alias("degradation"), (d <= 0.3).alias("passed"))


@query(SQL + """, l AS (SELECT strategy, ret, lag(ret) OVER (PARTITION BY strategy ORDER BY obs) AS before FROM rets), m AS (SELECT strategy, avg(abs(ret)) FILTER (before IS NOT NULL) AS now, avg(abs(before)) AS lagged FROM l GROUP BY strategy)
SELECT strategy, round(CASE WHEN abs(lagged) < 1e-12 THEN 0 ELSE (now - lagged) / abs(lagged) END, 8) AS leak, CASE WHEN abs(lagged) < 1e-12 THEN 0 ELSE (now - lagged) / abs(lagged) END > 0.2 AS leaking FROM m""")
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric that is much better without the lag looks ahead."""
    return leaks(returns(spark, sf_dir).withColumnRenamed("obs", "n"))


def leaks(r: DataFrame) -> DataFrame:
    """The same of given numbered series."""
    x = lagged(r, ["strategy"], {"before": F.col("ret")})
    m = x.groupBy("strategy").agg(F.avg(F.when(F.col("before").isNotNull(), F.abs("ret"))).alias("now"), F.avg(F.abs("before")).alias("lagged"))
    v = F.when(F.abs("lagged") < 1e-12, 0.0).otherwise((F.col("now") - F.col("lagged")) / F.abs("lagged"))
    return m.select("strategy", F.round(v, 8).alias("leak"), (v > 0.2).alias("leaking"))


FACTORS = (0.5, 0.75, 0.9, 1.1, 1.25, 1.5)


@query(SQL + f""", p AS (SELECT unnest(['cost', 'scale', 'cap']) AS param), fa AS (SELECT unnest([{", ".join(f"CAST({x} AS DOUBLE)" for x in FACTORS)}]) AS factor),
v AS (SELECT strategy, param, factor, avg(CASE param WHEN 'cost' THEN abs(ret) - 0.01 * factor WHEN 'scale' THEN abs(ret) * factor ELSE least(abs(ret), 0.4 * factor) END) AS perf,
 avg(CASE param WHEN 'cost' THEN abs(ret) - 0.01 WHEN 'scale' THEN abs(ret) ELSE least(abs(ret), 0.4) END) AS base FROM rets CROSS JOIN p CROSS JOIN fa GROUP BY ALL)
SELECT strategy, param, round(min(perf / base), 6) AS worst, bool_and(perf / base >= 0.5) AS robust FROM v GROUP BY ALL""")
def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One parameter at a time by six factors: robust where no result falls under half the base. One pass, no copies of the returns."""
    return sensitivities(returns(spark, sf_dir))


def sensitivities(r: DataFrame) -> DataFrame:
    """The same of given series."""
    a = F.abs("ret")
    value = {"cost": lambda f: a - 0.01 * f, "scale": lambda f: a * f, "cap": lambda f: F.least(a, F.lit(0.4 * f))}
    m = r.groupBy("strategy").agg(*[F.avg(g(f)).alias(f"{p}_{i}") for p, g in value.items() for i, f in enumerate((1.0, *FACTORS))])
    parts = []
    for p in value:
        ratio = [F.col(f"{p}_{i + 1}") / F.col(f"{p}_0") for i in range(len(FACTORS))]
        parts.append(F.struct(F.lit(p).alias("param"), F.round(F.least(*ratio), 6).alias("worst"), reduce(lambda x, y: x & y, [r >= 0.5 for r in ratio]).alias("robust")))
    return m.select("strategy", F.inline(F.array(*parts)))


@query(SQL + f"""SELECT strategy, 'Data Sufficiency' AS name, count(*) >= 2 AS passed, CAST(count(*) AS DOUBLE) AS value FROM rets GROUP BY strategy UNION ALL SELECT strategy, 'Sharpe Ceiling', {YEARLY} <= 1.5, {YEARLY} FROM rets GROUP BY strategy
 UNION ALL SELECT strategy, 'Complexity', {YEARLY} / sqrt(38) > 0 OR {YEARLY} <= 0, round({YEARLY} / sqrt(38), 6) FROM rets GROUP BY strategy""")
def validation_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered checks as rows: name, passed, value."""
    s = F.round(_yearly(), 7)
    m = returns(spark, sf_dir).groupBy("strategy").agg(F.count("*").alias("n"), s.alias("s"))
    a = F.col("s") / F.sqrt(F.lit(38.0))
    row = lambda name, ok, v: F.struct(F.lit(name).alias("name"), ok.alias("passed"), v.cast("double").alias("value"))
    return m.select("strategy", F.inline(F.array(row("Data Sufficiency", F.col("n") >= 2, F.col("n")), row("Sharpe Ceiling", F.col("s") <= 1.5, F.col("s")), row("Complexity", (a > 0) | (F.col("s") <= 0), F.round(a, 6)))))


def _checks(rows: DataFrame, name: str, passed, value) -> DataFrame:
    return rows.select("strategy", F.lit(name).alias("name"), passed.alias("passed"), value.cast("double").alias("value"))


def _all_checks() -> str:
    from ..plans.registry import ORACLES

    part = {k: ORACLES[k] for k in ("sharpe_ceiling", "dsr", "degradation", "leakage", "cpcv_scores", "sensitivity", "pbo")}
    return f"""SELECT strategy, 'Sharpe Ceiling' AS name, passed, sharpe AS value FROM ({part["sharpe_ceiling"]}) UNION ALL SELECT strategy, 'Complexity Penalty', complexity_passed, adjusted FROM ({part["sharpe_ceiling"]})
UNION ALL SELECT strategy, 'Live Degradation', passed, degradation FROM ({part["degradation"]}) UNION ALL SELECT strategy, 'Information Leakage', NOT leaking, leak FROM ({part["leakage"]}) UNION ALL SELECT strategy, 'CPCV', mean > 0 AND failure_rate < 0.5, mean FROM ({part["cpcv_scores"]})
UNION ALL SELECT strategy, 'Reward Sensitivity', bool_and(robust), CAST(bool_and(robust) AS INT) FROM ({part["sensitivity"]}) GROUP BY strategy UNION ALL SELECT 'ALL', 'PBO', passed, pbo FROM ({part["pbo"]}) UNION ALL SELECT strategy, 'Deflated Sharpe Ratio', passed, dsr FROM ({part["dsr"]})"""


@query(_all_checks())
def validation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight checks as rows (strategy, name, passed, value), over series that are written once."""
    r = series(spark, sf_dir)
    folds = stored(scores(r), "sharpes")
    c, d, k, v, s, p, e = ceilings(r), degraded(r), leaks(r), fold_scores(folds), sensitivities(r), overfitting(folds), deflation(r)
    robust = s.groupBy("strategy").agg(F.every("robust").alias("robust"))
    parts = [
        _checks(c, "Sharpe Ceiling", F.col("passed"), F.col("sharpe")), _checks(c, "Complexity Penalty", F.col("complexity_passed"), F.col("adjusted")), _checks(d, "Live Degradation", F.col("passed"), F.col("degradation")),
        _checks(k, "Information Leakage", ~F.col("leaking"), F.col("leak")), _checks(v, "CPCV", (F.col("mean") > 0) & (F.col("failure_rate") < 0.5), F.col("mean")), _checks(robust, "Reward Sensitivity", F.col("robust"), F.col("robust").cast("int")),
        _checks(p.withColumn("strategy", F.lit("ALL")), "PBO", F.col("passed"), F.col("pbo")), _checks(e, "Deflated Sharpe Ratio", F.col("passed"), F.col("dsr")),
    ]
    return reduce(DataFrame.unionByName, parts)


def verdict(r: DataFrame, num_features: int, ceiling: float = 1.5) -> DataFrame:
    """Checks of one series (obs, ret): name, passed, value. With fewer than two finite returns there is one check, and it fails; values that are not finite are 0."""
    one = r.where(F.col("ret").isNotNull() & ~F.isnan("ret") & (F.abs("ret") != F.lit(float("inf")))).withColumn("strategy", F.lit("run"))
    n = one.count()
    if n < 2:
        return r.sparkSession.createDataFrame([("Data Sufficiency", False, float(n))], "name string, passed boolean, value double")
    m = one.groupBy("strategy").agg(_yearly().alias("s"))
    z = deflated(one).select("strategy", normal_cdf(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), F.coalesce("z", F.lit(0.0))))).alias("p"))
    adjusted = F.col("s") / F.sqrt(F.lit(float(max(num_features, 1))))
    parts = [_checks(m, "Sharpe Ceiling", F.col("s") <= ceiling, F.col("s")), _checks(z, "Deflated Sharpe Ratio", F.col("p") >= 0.95, F.col("p")), _checks(m, "Complexity Penalty", (adjusted > 0) | (F.col("s") <= 0), adjusted)]
    if n >= GROUPS:
        t = scores(one).where("role = 'test'").groupBy("strategy").agg(F.avg("sharpe").alias("mean"), F.avg((F.col("sharpe") <= 0).cast("double")).alias("fails"))
        parts.append(_checks(t, "CPCV", (F.col("mean") > 0) & (F.col("fails") < 0.5), F.col("mean")))
    v = F.col("value")
    return reduce(DataFrame.unionByName, parts).select("name", "passed", F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), 0.0).otherwise(v).alias("value"))
