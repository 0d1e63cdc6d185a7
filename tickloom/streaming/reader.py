"""The lenient reader as a stateful stream: what was last accepted of each symbol, and its last quotes, outlive micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.stored import scratch
from ..plans.registry import query
from ..sources.quotes import faulty, typed
from ..sources.views import SQL
from .feed import drained, record, stream

#: Quotes of a symbol that are kept; rows of a micro-batch, and slices that it is read in at once.
WINDOW, SLICE, READERS = 50, 1 << 18, 8
PARTITIONS = "spark.sql.shuffle.partitions"
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = ["row", "ts_ns", "bid", "ask", "bid_size", "ask_size"]
QUOTE = "row bigint, ts_ns bigint, bid double, ask double, bid_size double, ask_size double"


class Lenient(StatefulProcessor):
    """Accepts a quote that is later than the last accepted one of its symbol.

    Value state holds that one's time, list state the last ``window`` accepted
    quotes. As the last accepted time is the greatest so far, a batch's quotes
    are judged by a running maximum. A symbol's rows of one micro-batch are in
    memory together, in the order of ``row``; the source bounds the batch.
    """

    def __init__(self, window: int) -> None:
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts_ns bigint")
        self.recent = handle.getListState("recent", QUOTE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows)).sort_values(["row", "ts_ns"], kind="stable")
        ts = x["ts_ns"].to_numpy()
        start = self.last.get()[0] if self.last.exists() else np.iinfo(np.int64).min
        before = np.maximum.accumulate(np.concatenate([[start], ts]))[:-1]
        x = x[ts > before]
        if x.empty:
            return
        kept = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        both = pd.concat([pd.DataFrame(kept, columns=FIELDS), x[FIELDS]]) if kept else x[FIELDS]
        self.last.update((int(x["ts_ns"].iloc[-1]),))
        self.recent.put([tuple(r) for r in both.tail(self.window).astype(object).itertuples(index=False, name=None)])
        total = np.concatenate([[0.0], np.cumsum((both["bid"] + both["ask"]).to_numpy(float) / 2)])
        end = np.arange(len(kept) + 1, len(both) + 1)
        begin = np.maximum(end - self.window, 0)
        yield x[FIELDS].assign(symbol=key[0], held=end - begin, mean_mid=(total[end] - total[begin]) / (end - begin))

    def close(self) -> None:
        pass


def follow(x: DataFrame, window: int = WINDOW) -> DataFrame:
    """A stream of text rows as accepted quotes, with ``held``, how many of its symbol's are kept with it, and ``mean_mid``, their mean price.

    Rows whose time or prices can't be read, crossed ones and those that are
    not later than the last accepted one of their symbol are skipped; a null
    symbol is the default one. Rows must come in the order of ``row`` from one
    micro-batch to the next, within one they may come in any.
    """
    if window < 1:
        raise ValueError("the window must hold a quote at least")
    t = typed(x).where("bad is null").select("symbol", *FIELDS)
    return t.groupBy("symbol").transformWithStateInPandas(Lenient(window), f"{QUOTE}, symbol string, held bigint, mean_mid double", "append", "none")


def read_along(x: DataFrame, name: str = "lenient", window: int = WINDOW) -> DataFrame:
    """``follow`` until the end of a recorded feed; this kind of state needs the RocksDB store, which is set for that long.

    Every micro-batch opens and commits a store for each partition, so there
    are no more of them than cores.
    """
    conf = x.sparkSession.conf
    had = {k: conf.get(k) for k in (STORE, PARTITIONS)}
    conf.set(STORE, ROCKS)
    conf.set(PARTITIONS, str(min(int(had[PARTITIONS]), max(x.sparkSession.sparkContext.defaultParallelism, 2))))
    try:
        return drained(follow(x, window), name)
    finally:
        for k, v in had.items():
            conf.set(k, v)


@query(SQL + """, raw AS (SELECT event_type AS symbol, event_id + 2 AS row, ts_ns - CASE WHEN event_id % 97 = 5 THEN 400000000000000 ELSE 0 END AS t, CASE WHEN event_id % 50 = 7 THEN 'x' ELSE CAST(c AS VARCHAR) END AS b, c + CASE WHEN event_id % 31 = 3 THEN -1 ELSE 2 END AS a FROM base),
ck AS (SELECT *, CASE WHEN b = 'x' THEN 'number' WHEN TRY_CAST(b AS BIGINT) >= a THEN 'crossed' END AS bad FROM raw), cp AS (SELECT *, max(CASE WHEN bad IS NULL THEN t END) OVER (PARTITION BY symbol ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ck)
SELECT symbol, row, t AS ts_ns, count(*) OVER w AS held, round(avg((CAST(b AS BIGINT) + a) / CAST(2 AS DOUBLE)) OVER w, 6) AS mean_mid FROM cp WHERE bad IS NULL AND (seen IS NULL OR t > seen) WINDOW w AS (PARTITION BY symbol ORDER BY row ROWS 49 PRECEDING)""")
def stream_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote text by symbol, recorded in the order of its rows, read along in several micro-batches."""
    raw = faulty(spark, sf_dir).withColumn("symbol", F.col("event_type")).drop("event_type")
    rows = raw.agg(F.max("row")).first()[0]
    if rows is None:
        return spark.createDataFrame([], "symbol string, row bigint, ts_ns bigint, held bigint, mean_mid double")
    r = record(raw, scratch(spark, "rows"), "row", -(-min(SLICE, rows // 4 + 1) // READERS))
    return read_along(stream(spark, r, most=READERS)).select("symbol", "row", "ts_ns", "held", F.round("mean_mid", 6).alias("mean_mid"))
