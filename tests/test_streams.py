"""The recorded feed and the reader that follows it: ranges, offsets, pace, state over micro-batches."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tickloom.functions.stored import scratch
from tickloom.sources.quotes import typed
from tickloom.streaming import feed
from tickloom.streaming.reader import follow, read_along


@pytest.fixture(scope="module")
def recorded(spark):
    x = spark.range(100).select((F.col("id") * 10 - 300).alias("ts_ns"), F.col("id").alias("seq")).unionByName(spark.createDataFrame([(None, 1000)], "ts_ns bigint, seq bigint"))
    return feed.record(x, scratch(spark, "recorded"), size=70)


def test_ranges_and_pushed_bounds(spark, recorded):
    assert feed.load(spark, recorded).count() == 100  # the row without a time has no place
    assert {r["seq"] for r in feed.load(spark, recorded, -300, -280).collect()} == {0, 1, 2}
    hit = feed.load(spark, recorded).where("ts_ns > 100 and ts_ns <= 130")
    assert {r["seq"] for r in hit.collect()} == {41, 42, 43}
    assert hit.rdd.getNumPartitions() < feed.load(spark, recorded).rdd.getNumPartitions()
    assert feed.load(spark, recorded).where("ts_ns > 100000").count() == 0


def test_stream_takes_slices_in_order(spark, recorded):
    got = feed.drained(feed.stream(spark, recorded, -250, 400, most=2), "order").collect()
    assert sorted(r["seq"] for r in got) == list(range(5, 71))
    by_time = [r["batch"] for r in sorted(got, key=lambda r: r["ts_ns"])]
    assert by_time == sorted(by_time) and len(set(by_time)) >= 4


def reader(recorded, **more):
    from pyspark.sql.types import LongType, StructField, StructType

    options = {"path": recorded.path, "by": "ts_ns", "size": "70", "speed": "0", "began": "0", "most": "2", "start": "-300", "end": "690", **{k: str(v) for k, v in more.items()}}
    return feed.FeedStream(options, StructType([StructField("ts_ns", LongType()), StructField("seq", LongType())]))


def test_offsets_never_go_back(spark, recorded):
    progress = feed._new(spark)
    first = reader(recorded, progress=progress)
    assert first.initialOffset() == {"at": -301}
    assert [first.latestOffset()["at"] for _ in range(9)] == [-161, -21, 119, 259, 399, 539, 679, 690, 690]
    assert reader(recorded).latestOffset() == {"at": 690}  # nothing tells where it was
    first.commit({"at": -21})
    assert reader(recorded, progress=progress).latestOffset() == {"at": 119}
    replayed = reader(recorded, progress=progress)
    replayed.partitions({"at": -21}, {"at": 119})
    assert replayed.latestOffset() == {"at": 259}
    with pytest.raises(ValueError):
        replayed.partitions({"at": 400}, {"at": 119})


def test_a_restarted_stream_goes_on(spark, recorded):
    progress, out = feed._new(spark), scratch(spark, "restart")

    def run(end):
        seen = []
        q = feed.stream(spark, recorded, -300, end, most=3, progress=progress).writeStream.foreachBatch(lambda b, i: seen.append(sorted(r["seq"] for r in b.collect()))).option("checkpointLocation", out).start()
        q.processAllAvailable()
        q.stop()
        return [x for x in seen if x]

    first, second = run(200), run(690)
    assert sum(first, []) == list(range(51)) and len(first) == 3
    assert sum(second, []) == list(range(51, 100)) and len(second) >= 2


def test_pace_follows_the_clock(spark, recorded):
    began = time.time()
    slow = reader(recorded, speed=1e-9 * 100, began=began - 2, most=100, progress=feed._new(spark))  # a hundred units a second
    slow.initialOffset()
    assert -110 <= slow.latestOffset()["at"] <= 0
    early = reader(recorded, speed=1e-9, began=began + 100)
    early.initialOffset()
    assert early.latestOffset() == {"at": -301}
    restarted = reader(recorded, speed=1e-9 * 100, began=began - 2, most=100)
    assert -110 <= restarted.latestOffset()["at"] <= 0


def test_state_outlives_batches(spark):
    rows = []
    for i in range(60):
        symbol = "AB"[i % 2]
        ts = 2_000_000_000_000_000_000 + i * 1000 - (50_000 if i in (20, 41) else 0)
        rows.append((i, str(ts) if i != 10 else "never", str(100 + i) if i != 13 else "?", str(101 + i) if i != 17 else "1", None, "7", symbol))
    rows += [(60, rows[58][1], "1", "2", None, None, "A"), (61, str(3_000_000_000_000_000_000), "1", "2", None, None, None)]
    x = spark.createDataFrame(rows, "row bigint, timestamp string, bid string, ask string, bid_volume string, ask_volume string, symbol string")
    want, state = [], {}
    for r in sorted(typed(x).collect(), key=lambda r: r["row"]):
        last, held = state.get(r["symbol"], (None, []))
        if r["bad"] is None and (last is None or r["ts_ns"] > last):
            held = [*held, (r["bid"] + r["ask"]) / 2][-5:]
            state[r["symbol"]] = (r["ts_ns"], held)
            want.append((r["symbol"], r["row"], r["ts_ns"], r["bid_size"], len(held), round(sum(held) / len(held), 9)))
    r = feed.record(x, scratch(spark, "text"), "row", 9)
    got = read_along(feed.stream(spark, r, most=1), "text", 5)
    found = got.collect()
    assert sorted((g["symbol"], g["row"], g["ts_ns"], g["bid_size"], g["held"], round(g["mean_mid"], 9)) for g in found) == sorted(want)
    assert len({g["batch"] for g in found}) >= 5 and len(want) == len(rows) - 6  # 10, 13, 17, 20, 41, 60
    with pytest.raises(ValueError):
        follow(x, 0)


def test_state_has_no_more_partitions_than_cores(spark, monkeypatch):
    from tickloom.streaming import reader as lenient

    key, seen = "spark.sql.shuffle.partitions", []
    had = spark.conf.get(key)
    x = spark.createDataFrame([], "row bigint, timestamp string, bid string, ask string, bid_volume string, ask_volume string, symbol string")
    monkeypatch.setattr(lenient, "follow", lambda x, window: x)
    monkeypatch.setattr(lenient, "drained", lambda x, name: seen.append(int(spark.conf.get(key))))
    try:
        spark.conf.set(key, "200")
        lenient.read_along(x)
        assert seen == [spark.sparkContext.defaultParallelism] and spark.conf.get(key) == "200"
    finally:
        spark.conf.set(key, had)
