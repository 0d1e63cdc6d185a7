"""Live variants: quotes as a stream, late and repeated events, windows of time, alerts by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.results import scratch
from ..sources.views import SQL


def quotes(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """The events table as a stream of quotes with event time; ``files`` a batch."""
    schema = spark.read.parquet(path).schema
    import posixpath

    folder, name = posixpath.split(path)
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return raw.select(F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id"), F.col("value"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def unique(s: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events once, by sequence number within the watermark: repeats of it or later ones are dropped and state is bounded."""
    return s.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "seq"])


def bars(s: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count and mean value by symbol and tumbling window."""
    return s.withWatermark("ts", late).groupBy("symbol", F.window("ts", size).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select("symbol", F.col("w.start").alias("start"), "n", "total")


def sessions(s: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of a user's events with pauses of at most ``gap``."""
    return s.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def drain(s: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is and read its result; checkpoints go to the shared folder."""
    spark = s.sparkSession
    out = scratch(spark, f"stream-{name}")

    def sink(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{out}/data")

    s.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(s.schema).parquet(f"{out}/data")


@query("SELECT event_type AS symbol, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS start_s, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars from the stream equal those of the whole table."""
    return drain(bars(quotes(spark, f"{sf_dir}/events.parquet")), "bars").select("symbol", F.unix_seconds("start").alias("start_s"), "n", "total")


@query(SQL + """, e AS (SELECT user_id, ts_ns, CASE WHEN ts_ns - lag(ts_ns) OVER (PARTITION BY user_id ORDER BY ts_ns) < 1800000000000 THEN 0 ELSE 1 END AS new FROM base), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts_ns ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, min(ts_ns) // 1000000000 AS start_s, count(*) AS n FROM r GROUP BY user_id, run""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows from the stream."""
    return drain(sessions(quotes(spark, f"{sf_dir}/events.parquet")), "sessions").select("user_id", F.unix_seconds("start").alias("start_s"), "n")


@query("SELECT event_type AS symbol, event_id AS seq FROM events")
def stream_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream joined with itself by union has each event once."""
    s = quotes(spark, f"{sf_dir}/events.parquet")
    return drain(unique(s.unionByName(s)), "unique", "append").select("symbol", "seq")
