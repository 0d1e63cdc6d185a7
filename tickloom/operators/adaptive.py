"""Change points of long histories by adaptive windows, in chunks.

A row's score looks at the last rows only, so chunks with a halo score all
rows. Which of them are change points depends on the one before, as each is
followed by a time of grace: a chunk becomes a map from the rows still to wait
at its begin to those at its end, maps are composed over chunks, and each
chunk is then gone through from its own entry.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import haloed, numbered, scan
from ..functions.stored import stored
from ..plans.registry import query
from ..sources.views import SQL, ticks

#: Rows of the smaller part of a window at least; rows of a window at most; rows of grace; chance of a false alarm; ratio of a major change; rows of a chunk.
LEAST, MOST, GRACE, DELTA, MAJOR, CHUNK = 50, 5000, 100, 0.002, 2.5, 20_000


def scores(x: np.ndarray, first: int, least: int, most: int, delta: float) -> np.ndarray:
    """For each row from ``first`` on, the greatest ratio of a split's mean difference to its bound, over windows that end at the row.

    0 where a window has fewer than two parts of ``least`` rows, or no finite score.
    """
    p = np.concatenate([[0.0], np.cumsum(x - x.mean())]) if len(x) else np.zeros(1)
    out, size = np.zeros(len(x) - first), 0
    for end in range(first + 1, len(x) + 1):
        m = min(end, most)
        if m < 2 * least:
            continue
        if m != size:
            size, k = m, np.arange(least, m - least + 1)
            root = np.sqrt(2 * np.minimum(k, m - k) / np.log(4 * len(k) / delta))
            left, right = root / k, root / (m - k)
        at = p[end - m + least : end - least + 1]
        best = np.abs((at - p[end - m]) * left - (p[end] - at) * right).max()
        out[end - first - 1] = best if np.isfinite(best) else 0.0
    return out


def waits(at: np.ndarray, rows: int, grace: int) -> list[int]:
    """Rows to wait after a chunk of ``rows`` by rows to wait before it (0 to grace - 1), if candidates lie ``at`` these places."""
    after = np.searchsorted(at, at + grace)
    ends = np.zeros(len(at) + 1, int)
    for j in range(len(at) - 1, -1, -1):
        ends[j] = ends[after[j]] if after[j] < len(at) else max(0, at[j] + grace - rows)
    w = np.arange(grace)
    j = np.searchsorted(at, w)
    return np.where(j < len(at), ends[j], np.maximum(0, w - rows)).tolist()


def _chunk(keys: list[str], least: int, most: int, grace: int, delta: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def work(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("n")
        own = f["own"].to_numpy()
        first = int((~own).sum())
        s = scores(f["x"].to_numpy(float), first, least, most, delta)
        mine = f[own]
        at = np.flatnonzero(s > 1)
        found = [{"at": int(i), "seq": int(q), "score": float(v)} for i, q, v in zip(at, mine["seq"].to_numpy()[at], s[at], strict=True)]
        head = {c: [f[c].iloc[0]] for c in (*keys, "chunk")}
        return pd.DataFrame({**head, "waits": [waits(at, len(mine), grace)], "found": [found]})

    return work


def changes(x: DataFrame, keys: list[str], least: int = LEAST, most: int = MOST, grace: int = GRACE, delta: float = DELTA, chunk: int = CHUNK) -> DataFrame:
    """Change points (keys, seq, score) of the column ``x`` in order of ``seq``; score above 1.

    The first ``least`` - 1 rows of a key are a warm-up that enters no window; a
    change point lies at least ``grace`` rows after the one before. Both means
    of a split are over all rows of their part. Rows whose ``x`` is null or not
    finite are left out.
    """
    if not 0 < most <= chunk or grace < 1 or least < 1:
        raise ValueError("windows must fit into a chunk, grace and least part be positive")
    x = x.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))).select(*keys, "seq", F.col("x").cast("double").alias("x"))
    x = numbered(x, keys).where(F.col("n") >= least).withColumn("n", F.col("n") - (least - 1))
    x = haloed(x, chunk, most)  # a window's rows before its last, and one more
    types = {f.name: f.dataType.simpleString() for f in x.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*keys, "chunk")) + ", waits array<int>, found array<struct<at: int, seq: bigint, score: double>>"
    each = stored(x.groupBy(*keys, "chunk").applyInPandas(_chunk(keys, least, most, grace, delta), schema), "windows")
    steps = each.select(*keys, (F.col("chunk") + 1).alias("n"), "waits")
    entry = scan(steps, keys, F.col("waits"), lambda f, g: F.transform(f, lambda w: F.element_at(g, w + 1)), lambda w, f: F.element_at(f, w + 1), F.lit(0)).select(*keys, (F.col("n") - 1).alias("chunk"), "before")
    none = F.array().cast("array<struct<at: int, seq: bigint, score: double>>")
    picked = F.aggregate(
        "found", F.struct(F.col("before").alias("free"), none.alias("kept")),
        lambda a, r: F.when(r["at"] < a["free"], a).otherwise(F.struct((r["at"] + grace).alias("free"), F.array_append(a["kept"], r).alias("kept"))), lambda a: a["kept"],
    )
    return each.where("size(found) > 0").join(entry, [*keys, "chunk"]).select(*keys, F.explode(picked).alias("c")).select(*keys, "c.seq", "c.score")


ONLINE = SQL.replace("WITH base", "WITH RECURSIVE base", 1) + f""", v AS (SELECT symbol, seq, unnest(['mid', 'depth']) AS feature, unnest([(bid + ask) / 2, (bid_size + ask_size) / 1000]) AS x FROM ticks),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol, feature ORDER BY seq) - {LEAST - 1} AS n FROM v), p AS MATERIALIZED (SELECT symbol, feature, seq, n, sum(x - 80) OVER (PARTITION BY symbol, feature ORDER BY n ROWS UNBOUNDED PRECEDING) AS p FROM n WHERE n > 0),
e AS (SELECT e.*, least(e.n, {MOST}) AS m, coalesce(b.p, 0) AS p0 FROM p e LEFT JOIN p b ON b.symbol = e.symbol AND b.feature = e.feature AND b.n = e.n - {MOST}),
s AS (SELECT e.symbol, e.feature, e.seq, e.n, max(abs((c.p - p0) / (c.n - e.n + m) - (e.p - c.p) / (e.n - c.n)) / sqrt(ln(4 * (m - {2 * LEAST} + 1) / CAST({DELTA} AS DOUBLE)) / (2 * least(c.n - e.n + m, e.n - c.n)))) AS score
 FROM e JOIN p c ON c.symbol = e.symbol AND c.feature = e.feature AND c.n BETWEEN e.n - m + {LEAST} AND e.n - {LEAST} GROUP BY ALL),
c AS MATERIALIZED (SELECT * FROM s WHERE score > 1), d AS MATERIALIZED (SELECT c.*, a.n AS nxt FROM c ASOF LEFT JOIN c a ON a.symbol = c.symbol AND a.feature = c.feature AND c.n + {GRACE} <= a.n),
k AS (SELECT d.* FROM d JOIN (SELECT symbol, feature, min(n) AS n FROM d GROUP BY ALL) f USING (symbol, feature, n) UNION ALL SELECT d.* FROM k JOIN d ON d.symbol = k.symbol AND d.feature = k.feature AND d.n = k.nxt)
SELECT symbol, feature, seq, round(score, 6) AS score, score >= {MAJOR} AS major FROM k"""


@query(ONLINE)
def adwin_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change points of the mid price and of the depth in thousands as quotes pass, and whether they are major."""
    t = ticks(spark, sf_dir).select("symbol", "seq", ((F.col("bid") + F.col("ask")) / 2).alias("mid"), ((F.col("bid_size") + F.col("ask_size")) / 1000).alias("depth"))
    x = changes(t.unpivot(["symbol", "seq"], ["mid", "depth"], "feature", "x"), ["symbol", "feature"])
    return x.select("symbol", "feature", "seq", F.round("score", 6).alias("score"), (F.col("score") >= MAJOR).alias("major"))
