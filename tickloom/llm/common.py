"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: list[tuple[SparkSession, str]] = []
_OWN: dict[str, str] = {}
#: Bytes of an Arrow batch (or one longer row) between the JVM and Python, where the session sets no bound of its own; parts of all rows from which on a key is hot.
BATCH, HOT = 2 << 20, 1000


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` over batches that are bounded by bytes, since texts differ in length by orders of magnitude."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return df.mapInArrow(run, schema)


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], spread: list[str], count: str = "n", how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Join of rows (all, if ``how`` is left) with a frame of one row a key, in which ``count`` is the number of the key's rows.

    A key with more than 1 / ``HOT`` of all rows is dealt over as many parts
    as its share needs, by the hash of the columns ``spread``. There are fewer
    than ``HOT`` such keys, so the list of them is broadcast. ``counts``, the
    keys and counts of ``keyed`` by themselves, spares a second copy of its
    plan where it is not a written table.
    """
    counts = keyed if counts is None else counts
    total = int(counts.agg(F.sum(count)).first()[0] or 0)
    parts = F.ceil(F.col(count) * HOT / F.lit(max(total, 1))).cast("int")
    hot = counts.where(F.col(count) * HOT > total).select(*on, parts.alias("__parts"))
    dealt = keyed.withColumn("__part", F.explode(F.sequence(F.lit(0), F.when(F.col(count) * HOT > total, parts).otherwise(1) - 1)))
    part = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("__parts")).cast("int"), F.lit(0))
    return rows.join(F.broadcast(hot), on, "left").withColumn("__part", part).drop("__parts").join(dealt, [*on, "__part"], how).drop("__part")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and all run on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        key = spark.sparkContext.applicationId
        if key not in _OWN:
            _OWN[key] = tempfile.mkdtemp(prefix="tickloom-")
        found = _OWN[key]
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it again.

    This cuts the lineage; the files survive the loss of any executor. They
    go when the application ends, or with ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tickloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return scratch(spark, path, df.schema)


def scratch(spark: SparkSession, path: str, schema) -> DataFrame:
    """A written table that goes when the application ends, or with ``discard``."""
    _SCRATCH.append((spark, path))
    out = spark.read.schema(schema).parquet(path)
    out._tickloom_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for a frame that no later plan reads."""
    path = getattr(df, "_tickloom_path", None)
    if path:
        _delete(df.sparkSession, path)
        _SCRATCH[:] = [x for x in _SCRATCH if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _SCRATCH:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def text_or_empty(col: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of undirected edges (src, dst): (id, component), the smallest id reachable.

    Each round hooks every label to the smallest label across any edge, then
    jumps pointers twice. Labels only shrink, so it ends when no label moves.
    All steps are aggregates by minimum (combined before the shuffle) and
    equi-joins, so a hub with very many edges is no single task's work.
    Only ids that have an edge are returned.
    """
    both = materialize(
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"))
        .select("e.*")
        .distinct(),
        f"{tag}-edges",
    )
    labels = materialize(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("src")).alias("component")), f"{tag}-labels")
    while True:
        # the smallest neighbouring label, offered to an id and to its present root
        seen = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        offer = materialize(labels.join(seen, "id").select("id", "component", F.least("component", "near").alias("near")), f"{tag}-offer")
        roots = materialize(offer.groupBy(F.col("component").alias("root")).agg(F.min("near").alias("next")), f"{tag}-roots")
        hop = roots.join(roots.select(F.col("root").alias("next"), F.col("next").alias("after")), "next", "left").select("root", F.coalesce("after", "next").alias("next"))
        moved = materialize(
            offer.join(hop, offer.component == hop.root, "left").select("id", F.least("near", F.coalesce("next", "near")).alias("component"), (F.least("near", F.coalesce("next", "near")) < F.col("component")).alias("moved")),
            f"{tag}-labels",
        )
        more = moved.where("moved").limit(1).count()
        for old in (labels, offer, roots):
            discard(old)
        labels = moved
        if not more:
            discard(both)
            return labels.select("id", "component")
