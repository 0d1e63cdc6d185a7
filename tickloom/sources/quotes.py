"""Quote files: header names, time stamps, strict and lenient CSV, replay and session messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import carried_last, carried_max, lagged, numbered
from ..plans.registry import query
from .views import SQL, table, ticks

#: Names that a header may use for a column.
ALIASES = {
    **{k: "timestamp" for k in ("local_time", "time", "timestamp", "datetime", "date", "time_(eet)")},
    **{k: "bid_volume" for k in ("bid_volume", "bidvolume", "bid_size")}, **{k: "ask_volume" for k in ("ask_volume", "askvolume", "ask_size")},
    **{k: "symbol" for k in ("symbol", "ticker", "pair")},
}
DEFAULT_SYMBOL = "USD/JPY"
ZONE = "Europe/Helsinki"

#: Rows of a file that are put in order at once.
ROWS = 1 << 16


def header_name(name: str) -> str:
    """Trimmed, lower case, underscores for spaces, aliases resolved."""
    x = name.strip().lower().replace(" ", "_")
    return ALIASES.get(x, x)


def _ns(ts: Column) -> Column:
    return F.unix_micros(ts) * 1000


def timestamp_ns(s: Column) -> Column:
    """Nanoseconds of a time stamp, null if it is none of the known forms.

    Digits above 1e15 are nanoseconds, up to ten digits seconds, thirteen are
    refused; ``DD.MM.YYYY … GMT±HHMM``; ``YYYY.MM.DD …`` in the trading zone;
    ISO with ``T`` or a space as UTC.
    """
    s = F.trim(s)
    digits = F.try_to_number(s, F.lit("9" * 19)).cast("bigint")
    gmt = F.regexp_extract(s, r"GMT([+-]\d{2})(\d{2})$", 0)
    sign = F.when(F.substring(gmt, 4, 1) == "-", -1).otherwise(1)
    off = sign * (F.substring(gmt, 5, 2).try_cast("bigint") * 3600 + F.substring(gmt, 7, 2).try_cast("bigint") * 60)
    dotted = F.trim(F.regexp_replace(s, r"\s*GMT[+-]\d{4}$", ""))
    iso = F.replace(s, F.lit("T"), F.lit(" "))
    both = lambda x, f: F.try_to_timestamp(x, F.lit(f + "[.SSSSSSSSS]"))  # noqa: E731  one to nine digits
    return (
        F.when(s.rlike(r"^\d+$"), F.when(digits > 10**15, digits).when(F.length(s) <= 11, digits * 1_000_000_000))
        .when(s.rlike(r"^\d{2}\.\d{2}\.\d{4} .*GMT[+-]\d{4}$"), _ns(both(dotted, "dd.MM.yyyy HH:mm:ss")) - off * 1_000_000_000)
        .when(s.rlike(r"^\d{4}\.\d{2}\.\d{2} "), _ns(F.to_utc_timestamp(both(s, "yyyy.MM.dd HH:mm:ss"), ZONE)))
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), _ns(both(iso, "yyyy-MM-dd HH:mm:ss")))
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quote files as text columns under their normalised names, with ``row`` from 2 in each file's order, however it is split.

    A part of a file is known by where it begins; rows count on from those of
    the parts before.
    """
    raw = spark.read.option("header", True).csv(path)
    x = raw.select(*[F.col(f"`{c}`").alias(header_name(c)) for c in raw.columns], F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__id"))
    for c, v in (("bid_volume", None), ("ask_volume", None), ("symbol", DEFAULT_SYMBOL)):
        if c not in x.columns:
            x = x.withColumn(c, F.lit(v).cast("string"))
    part = x.groupBy("__file", "__at").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__file").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.select("__file", "__at", "__first", before.alias("__before"))
    return x.join(part, ["__file", "__at"]).withColumn("row", F.col("__id") - F.col("__first") + F.col("__before") + 2).drop("__file", "__at", "__id", "__first", "__before")


def typed(x: DataFrame) -> DataFrame:
    """Quotes from text columns, with ``bad``: the first rule that a row breaks by itself, or null."""
    t = x.select(
        "row", timestamp_ns(F.col("timestamp")).alias("ts_ns"), F.col("bid").try_cast("double").alias("bid"), F.col("ask").try_cast("double").alias("ask"),
        F.coalesce(F.col("bid_volume").try_cast("double"), F.lit(0.0)).alias("bid_size"), F.coalesce(F.col("ask_volume").try_cast("double"), F.lit(0.0)).alias("ask_size"), F.coalesce("symbol", F.lit(DEFAULT_SYMBOL)).alias("symbol"),
    )
    bad = F.when(F.col("ts_ns").isNull(), "timestamp").when(F.col("bid").isNull() | F.col("ask").isNull(), "number").when(F.col("bid") >= F.col("ask"), "crossed")
    return t.withColumn("bad", bad)


def checked(x: DataFrame) -> DataFrame:
    """Typed quotes with ``problem``: the first rule that a row breaks, or null. Order is by ``row``."""
    t = typed(x).withColumns({"chunk": F.floor(F.col("row") / ROWS)}).withColumn("fine", F.when(F.col("bad").isNull(), F.col("ts_ns")))
    w = Window.partitionBy("symbol", "chunk").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest(F.max("fine").over(w), F.col("before"))  # the last accepted one is the greatest
    return t.join(carried_max(t, ["symbol"], "fine"), ["symbol", "chunk"]).withColumn("problem", F.coalesce("bad", F.when(F.col("ts_ns") <= seen, "order"))).drop("bad", "fine", "chunk", "before")


def lenient(x: DataFrame) -> DataFrame:
    """Quotes without the rows that break a rule."""
    return checked(x).where("problem is null").drop("problem")


def strict(x: DataFrame) -> DataFrame:
    """Quotes, or an error that names the first bad row."""
    c = checked(x)
    first = c.where("problem is not null").orderBy("row").select("row", "problem").first()
    if first:
        raise ValueError(f"row {first['row']}: {first['problem']}")
    return c.drop("problem")


RAW = SQL + """, raw AS (SELECT event_id + 2 AS row, event_id, ts_ns - CASE WHEN event_id % 97 = 5 THEN 400000000000000 ELSE 0 END AS t, CASE WHEN event_id % 50 = 7 THEN 'x' ELSE CAST(c AS VARCHAR) END AS b, c + CASE WHEN event_id % 31 = 3 THEN -1 ELSE 2 END AS a FROM base),
ck AS (SELECT row, t, CASE WHEN b = 'x' THEN 'number' WHEN TRY_CAST(b AS BIGINT) >= a THEN 'crossed' END AS bad FROM raw),
cp AS (SELECT row, coalesce(bad, CASE WHEN t <= max(CASE WHEN bad IS NULL THEN t END) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'order' END) AS problem FROM ck)
"""


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the text rows of a quote file, with faults put in, and the type of each."""
    e = table(spark, sf_dir, "events")
    i, c = F.col("event_id"), F.round(F.col("value") * 100).cast("bigint")
    ts = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 - F.when(i % 97 == 5, 400_000_000_000_000).otherwise(0)
    return e.select(
        (i + 2).alias("row"), ts.cast("string").alias("timestamp"), F.when(i % 50 == 7, "x").otherwise(c.cast("string")).alias("bid"), (c + F.when(i % 31 == 3, -1).otherwise(2)).cast("string").alias("ask"),
        F.lit(None).cast("string").alias("bid_volume"), F.lit(None).cast("string").alias("ask_volume"), F.lit(None).cast("string").alias("symbol"), "event_type",
    )


@query(RAW + "SELECT problem, count(*) AS n, min(row) AS first_row FROM cp WHERE problem IS NOT NULL GROUP BY problem")
def csv_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a strict reader refuses, by rule, with the first of each."""
    return checked(faulty(spark, sf_dir)).where("problem is not null").groupBy("problem").agg(F.count("*").alias("n"), F.min("row").alias("first_row"))


@query(RAW + "SELECT row FROM cp WHERE problem IS NULL")
def csv_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a lenient reader accepts."""
    return lenient(faulty(spark, sf_dir)).select("row")


@query(SQL + "SELECT event_id, ts_ns // 1000000000 * 1000000000 AS seconds, ts_ns AS nanos, ts_ns // 1000000000 * 1000000000 AS iso, ts_ns // 1000000000 * 1000000000 AS gmt, (ts_ns // 1000000000) * 1000000000 AS helsinki FROM base")
def timestamp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One moment written in each known form comes back the same."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    ns = F.unix_micros("ts") * 1000
    shown = {
        "seconds": F.expr("(unix_micros(ts) div 1000000)").cast("string"), "nanos": ns.cast("string"), "iso": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        "gmt": F.concat(F.date_format(F.expr("ts + interval 9 hours"), "dd.MM.yyyy HH:mm:ss"), F.lit(" GMT+0900")), "helsinki": F.date_format(F.from_utc_timestamp("ts", ZONE), "yyyy.MM.dd HH:mm:ss"),
    }
    return e.select("event_id", *[timestamp_ns(v).alias(k) for k, v in shown.items()])


@query(SQL + ", m AS (SELECT min(ts_ns) AS a, max(ts_ns) AS b FROM ticks) SELECT symbol, seq, ts_ns FROM ticks, m WHERE ts_ns BETWEEN a + (b - a) // 4 AND a + (b - a) // 2")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of an inclusive time range; the bounds are literals when the scan runs."""
    a, b = ticks(spark, sf_dir).agg(F.min("ts_ns"), F.max("ts_ns")).first()
    return ticks(spark, sf_dir, a + (b - a) // 4, a + (b - a) // 2).select("symbol", "seq", "ts_ns")


@query(SQL + "SELECT symbol, seq FROM ticks WHERE seq >= 500 ORDER BY symbol, seq")
def replay_from_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay of a stream from a sequence number on, in order."""
    return ticks(spark, sf_dir).where("seq >= 500").select("symbol", "seq").orderBy("symbol", "seq")


@query(SQL + ", n AS (SELECT symbol, seq, row_number() OVER (PARTITION BY symbol ORDER BY seq) - 1 AS i FROM ticks) SELECT symbol, seq, max(CASE WHEN i % 10 = 0 THEN seq END) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS base_seq FROM n")
def delta_base_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full record that a delta record starts from: every tenth one is full."""
    x = numbered(ticks(spark, sf_dir).select("symbol", "seq"), ["symbol"]).withColumn("full", F.when((F.col("n") - 1) % 10 == 0, F.col("seq")))
    return carried_last(x, ["symbol"], "full", "base_seq").select("symbol", "seq", "base_seq")


@query(SQL + ", m AS (SELECT max(ts_ns) AS b FROM ticks) SELECT symbol, count(*) FILTER (ts_ns >= b - 86400000000000) AS live, count(*) FILTER (ts_ns < b - 86400000000000) AS archived FROM ticks, m GROUP BY symbol")
def ttl_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records younger than a day are live, others go to the archive."""
    t = ticks(spark, sf_dir)
    since = t.agg(F.max("ts_ns")).first()[0] - 86_400_000_000_000
    return t.groupBy("symbol").agg(F.count_if(F.col("ts_ns") >= since).alias("live"), F.count_if(F.col("ts_ns") < since).alias("archived"))


@query(SQL + """, g AS (SELECT symbol, ts_ns, lag(ts_ns) OVER (PARTITION BY symbol ORDER BY seq) AS b FROM ticks)
SELECT symbol, count(*) AS n, round(CASE WHEN count(*) > 1 THEN (max(ts_ns) - min(ts_ns)) / CAST(count(*) - 1 AS DOUBLE) / 1000000 ELSE 0 END, 6) AS mean_gap_ms, max(ts_ns - b) // 1000000 AS longest_gap_ms, coalesce(count(*) FILTER (ts_ns - b > 600000000000), 0) AS unhealthy FROM g GROUP BY symbol""")
def feed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and longest gap of a feed, and how often it was unhealthy (over ten minutes)."""
    t = numbered(ticks(spark, sf_dir).select("symbol", "seq", "ts_ns"), ["symbol"])
    g = lagged(t, ["symbol"], {"before": F.col("ts_ns")}).withColumn("gap", F.col("ts_ns") - F.col("before"))
    n = F.count("*")
    return g.groupBy("symbol").agg(
        n.alias("n"), F.when(n > 1, F.round((F.max("ts_ns") - F.min("ts_ns")) / (n - 1) / 1000000, 6)).otherwise(0.0).alias("mean_gap_ms"), F.expr("max(gap) div 1000000").alias("longest_gap_ms"), F.count_if(F.col("gap") > 600_000_000_000).alias("unhealthy")
    )


SOH = "\u0001"


def checksum(body: Column) -> Column:
    """Sum of the bytes modulo 256, three digits."""
    return F.lpad((F.aggregate(F.transform(F.split(F.hex(F.encode(body, "UTF-8")), "(?<=\\G..)"), lambda h: F.coalesce(F.conv(h, 16, 10).try_cast("int"), F.lit(0))), F.lit(0), lambda a, b: a + b) % 256).cast("string"), 3, "0")


@query("""SELECT CAST(o_orderkey AS BIGINT) AS seq, CAST(o_custkey AS BIGINT) AS cust, CAST(round(o_totalprice * 100) AS BIGINT) AS price_c, true AS sum_ok FROM orders""")
def fix_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session messages of tag=value fields are built with their check sum, then parsed and verified."""
    o = table(spark, sf_dir, "orders")
    c = F.round(F.col("o_totalprice") * 100).cast("bigint")
    body = F.concat_ws(SOH, F.lit("8=FIX.4.4"), F.lit("35=D"), F.concat(F.lit("34="), F.col("o_orderkey").cast("string")), F.concat(F.lit("1="), F.col("o_custkey").cast("string")), F.concat(F.lit("44="), c.cast("string")), F.lit(""))
    m = o.select(F.concat(body, F.lit("10="), checksum(body), F.lit(SOH)).alias("raw"))
    p = m.select("raw", F.str_to_map(F.regexp_replace("raw", SOH + "$", ""), F.lit(SOH), F.lit("=")).alias("f"))
    head = F.regexp_replace("raw", "10=\\d{3}" + SOH + "$", "")
    return p.select(F.col("f")["34"].cast("bigint").alias("seq"), F.col("f")["1"].cast("bigint").alias("cust"), F.col("f")["44"].cast("bigint").alias("price_c"), (F.col("f")["10"] == checksum(head)).alias("sum_ok"))
