"""A recorded feed as a data source: rows lie in slices of an ordered column and are read by range, at once or as a paced stream."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.stored import scratch
from ..plans.registry import query
from ..sources.views import SQL, ticks

#: Nanoseconds of a slice of quotes; slices that a micro-batch takes at most.
HOUR, MOST = 3_600_000_000_000, 24


@dataclass(frozen=True)
class Recorded:
    """Where a feed lies, the whole-number column that it is ordered by, and how much of it a slice holds."""

    path: str
    by: str = "ts_ns"
    size: int = HOUR


def record(df: DataFrame, path: str, by: str = "ts_ns", size: int = HOUR) -> Recorded:
    """Write rows as slices of ``by``; a row without it has no place in the order and is left out."""
    x = df.where(F.col(by).isNotNull()).repartitionByRange(by)
    x.withColumn("slice", F.floor(F.col(by) / size)).write.partitionBy("slice").parquet(path)
    return Recorded(path, by, size)


def _place(path: str):
    """The file system of a path and the path on it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _slices(path: str) -> list[int]:
    from pyarrow.fs import FileSelector, FileType

    on, at = _place(path)
    found = (f.base_name for f in on.get_file_info(FileSelector(at)) if f.type == FileType.Directory)
    return sorted(int(name.removeprefix("slice=")) for name in found if name.startswith("slice="))


def _files(path: str, number: int) -> list[str]:
    from pyarrow.fs import FileSelector

    on, at = _place(path)
    return sorted(f.path for f in on.get_file_info(FileSelector(f"{at}/slice={number}")) if f.base_name.endswith(".parquet"))


@dataclass
class Part(InputPartition):
    """One file and the range (both ends included) that is wanted of it."""

    file: str
    low: int
    high: int


class _Ranges:
    """What reading by range needs: slices that a range meets, their files, and the rows of a file."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.by, self.size = options["path"], options["by"], int(options["size"])
        self.names = schema.names
        self.numbers = _slices(self.path)
        least, most = (self.numbers[0] * self.size, (self.numbers[-1] + 1) * self.size - 1) if self.numbers else (0, -1)
        self.low, self.high = max(int(options.get("start", least)), least), min(int(options.get("end", most)), most)

    def parts(self, low: int, high: int) -> list[Part]:
        hit = [n for n in self.numbers if n * self.size <= high and (n + 1) * self.size > low]
        return [Part(f, low, high) for n in hit for f in _files(self.path, n)]

    def rows(self, part: Part) -> Iterator:
        from pyarrow import dataset

        on, _ = _place(self.path)
        at = dataset.field(self.by)
        yield from dataset.dataset(part.file, filesystem=on, format="parquet").to_batches(columns=self.names, filter=(at >= part.low) & (at <= part.high))


class FeedReader(DataSourceReader):
    """A range at once. Bounds on the ordered column choose slices; Spark applies them again to rows."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.ranges = _Ranges(options, schema)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        r = self.ranges
        for f in filters:
            if getattr(f, "attribute", None) == (r.by,) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    r.low = max(r.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    r.high = min(r.high, f.value - isinstance(f, LessThan))
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        # Spark reads a source without partitions as one that has a single, unknown one
        return self.ranges.parts(self.ranges.low, self.ranges.high) or [Part("", 0, -1)]

    def read(self, partition: Part) -> Iterator:
        return self.ranges.rows(partition) if partition.file else iter(())


class FeedStream(DataSourceStreamReader):
    """A range as a stream. An offset is the last value of the ordered column that has been released.

    With a speed, what is released by now follows from the clock alone: the
    range's begin plus the time since ``began`` times the speed; so a restarted
    stream goes on where the clock is and never back. Without one all is
    released. A micro-batch takes at most ``most`` slices. As Spark asks for
    the latest offset before it says where a stream was, that is kept in the
    file ``progress``, one for each checkpoint; without it the first batch
    after a start takes all that is released.
    """

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.ranges = _Ranges(options, schema)
        self.speed, self.began = float(options["speed"]), float(options["began"])
        self.step = int(options["most"]) * self.ranges.size
        self.progress = options.get("progress")
        self.last = self._reached() if self.progress else None

    def _reached(self) -> int:
        on, at = _place(self.progress)
        try:
            with on.open_input_file(at) as f:
                return int(f.read())
        except FileNotFoundError:
            return self.ranges.low - 1

    def initialOffset(self) -> dict:
        return {"at": self.ranges.low - 1}

    def latestOffset(self) -> dict:
        r = self.ranges
        out = max(r.high, r.low - 1)
        if self.speed > 0:
            out = max(r.low - 1, min(out, r.low + int((time.time() - self.began) * 1e9 * self.speed)))
        if self.last is not None:
            out = max(self.last, min(out, self.last + self.step))
        self.last = out
        return {"at": out}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if end["at"] < start["at"]:
            raise ValueError(f"the feed was at {start['at']} already: {self.progress} belongs to another checkpoint")
        self.last = end["at"] if self.last is None else max(end["at"], self.last)
        return self.ranges.parts(start["at"] + 1, end["at"])

    def commit(self, end: dict) -> None:
        if self.progress:
            on, at = _place(self.progress)
            with on.open_output_stream(f"{at}.new") as f:
                f.write(str(end["at"]).encode())
            on.move(f"{at}.new", at)

    def read(self, partition: Part) -> Iterator:
        return self.ranges.rows(partition)


class RecordedFeed(DataSource):
    """Format ``recorded``; options path, by, size, and of need start, end (both included), speed, began (seconds), most, progress."""

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> StructType:
        from pyarrow import parquet
        from pyspark.sql.pandas.types import from_arrow_schema

        path = self.options["path"]
        on, _ = _place(path)
        for n in _slices(path):
            for f in _files(path, n):
                return from_arrow_schema(parquet.read_schema(f, filesystem=on))
        raise ValueError(f"no rows are recorded at {path}: give a schema")

    def _all(self) -> dict[str, str]:
        return {"by": "ts_ns", "size": str(HOUR), "speed": "0", "began": str(time.time()), "most": str(MOST), **dict(self.options)}

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeedReader(self._all(), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FeedStream(self._all(), schema)


def _options(r: Recorded, start: int | None, end: int | None) -> dict[str, str]:
    return {"path": r.path, "by": r.by, "size": str(r.size), **({} if start is None else {"start": str(start)}), **({} if end is None else {"end": str(end)})}


def load(spark: SparkSession, r: Recorded, start: int | None = None, end: int | None = None, schema: StructType | None = None) -> DataFrame:
    """A range of a recorded feed, both ends included. The session is set to hand filters to Python sources, so that bounds on the ordered column choose slices."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedFeed)
    read = spark.read.format("recorded").options(**_options(r, start, end))
    return (read if schema is None else read.schema(schema)).load()


def _new(spark: SparkSession) -> str:
    path = scratch(spark, "progress")
    on, at = _place(path)
    on.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return path


def stream(spark: SparkSession, r: Recorded, start: int | None = None, end: int | None = None, speed: float = 0.0, most: int = MOST, began: float | None = None, progress: str | None = None, schema: StructType | None = None) -> DataFrame:
    """The same as a stream: ``speed`` 1 is the pace at which it was recorded, 0 or less the fastest; ``most`` slices a micro-batch. A restart gives the same ``began`` and ``progress``, by default a new file."""
    spark.dataSource.register(RecordedFeed)
    read = spark.readStream.format("recorded").options(**_options(r, start, end), speed=str(speed), most=str(most), began=str(time.time() if began is None else began), progress=progress or _new(spark))
    return (read if schema is None else read.schema(schema)).load()


def drained(s: DataFrame, name: str) -> DataFrame:
    """Run a stream over a feed until its end and read what came, with ``batch``, the number of the micro-batch; one that is done again replaces itself."""
    spark = s.sparkSession
    out = scratch(spark, f"feed-{name}")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    running = s.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/checkpoint").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.schema(StructType([*s.schema.fields, StructField("batch", LongType())])).parquet(f"{out}/data")


@query(SQL + ", m AS (SELECT min(ts_ns) AS a, max(ts_ns) AS b FROM ticks) SELECT symbol, seq, ts_ns, bid, ask FROM ticks, m WHERE ts_ns BETWEEN a + (b - a) // 4 AND a + (b - a) // 2")
def recorded_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All quotes are recorded in slices of an eighth; a range of them comes back as a stream, one slice a micro-batch."""
    t = ticks(spark, sf_dir)
    a, b = t.agg(F.min("ts_ns"), F.max("ts_ns")).first()
    if a is None:
        return t.select("symbol", "seq", "ts_ns", "bid", "ask")
    r = record(t, scratch(spark, "feed"), size=max(1, -(-(b - a) // 8)))
    return drained(stream(spark, r, a + (b - a) // 4, a + (b - a) // 2, most=1), "range").select("symbol", "seq", "ts_ns", "bid", "ask")
