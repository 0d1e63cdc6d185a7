"""Ordered operators whose work is cut into chunks, so that no key's whole history is one task.

A row number comes from counts of sequence buckets and a carried offset; finite
frames work on chunks of rows with a halo of the rows before; running values
combine a chunk's own value with what the chunks before carry; an as-of join
works within a stretch of time and takes the last state of earlier stretches;
what is a fold by nature is composed: each chunk of steps is one step, those
are scanned in the same way, and the chunk is replayed from its entry state.
The windows over whole keys that remain see one row for each chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

#: Rows that each of Spark's windows keeps as plain rows; one row more, and every window of a task takes a page of up to 64 MB.
HELD = 4096
#: Sequence numbers of a bucket that is numbered at once; rows of a chunk and of the halo before it, together HELD; nanoseconds of a stretch of an as-of join; rows of a block of an exponential mean.
BUCKET, CHUNK, HALO, STRETCH, BLOCK = 1 << 16, HELD - 640, 640, 3_600_000_000_000, 256
#: Steps of a chunk that is composed and replayed as an array; longest block of an exponential mean; what is left of a block that doubles no longer see, and the largest power they hold, as logarithms.
FAN, LONGEST, UNSEEN, LARGEST = 128, 1 << 16, 39.0, 600.0


def numbered(df: DataFrame, keys: list[str], seq: str = "seq", bucket: int = BUCKET) -> DataFrame:
    """The rows with ``n``, their number (from 1) within their key by ``seq``."""
    b = F.floor(F.col(seq) / bucket).alias("__b")
    size = df.groupBy(*keys, b).agg(F.count("*").alias("__size"))
    over = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = size.select(*keys, "__b", F.coalesce(F.sum("__size").over(over), F.lit(0)).alias("__before"))
    w = Window.partitionBy(*keys, "__b").orderBy(seq)
    return df.withColumn("__b", b).join(before, [*keys, "__b"]).withColumn("n", F.row_number().over(w) + F.col("__before")).drop("__b", "__before")


def haloed(df: DataFrame, chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    """Numbered rows in chunks: each row in its own (``own``), the last ones also before the next chunk's."""
    at = F.floor((F.col("n") - 1) / chunk)
    late = (F.col("n") - 1) % chunk >= chunk - halo
    copies = F.when(late, F.array(F.struct(at.alias("chunk"), F.lit(True).alias("own")), F.struct((at + 1).alias("chunk"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(at.alias("chunk"), F.lit(True).alias("own"))))
    return df.withColumn("__c", F.explode(copies)).select(*df.columns, "__c.chunk", "__c.own")


def frame_sums(x: DataFrame, w, col: str | Sequence[str] | dict[str, tuple[int, ...]], rows: tuple[int, ...] = ()) -> DataFrame:
    """Moments of ``col`` (nulls left out) over the last rows of each frame size: col_count_r, col_mean_r, col_m2_r (sum of squares about the mean).

    Running sums and their lag, centred on the chunk's mean, in place of a sum
    over each row's frame. Several columns share the three windows, each of
    which holds a chunk in memory; a dict gives each column its frame sizes.
    """
    cols = col if isinstance(col, dict) else {c: rows for c in ([col] if isinstance(col, str) else col)}
    all_of = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({f"__mid_{c}": F.coalesce(F.avg(c).over(all_of), F.lit(0.0)) for c in cols})
    own = {}
    for c in cols:
        d = F.col(c) - F.col(f"__mid_{c}")
        own |= {f"__n_{c}": F.count(c).over(running), f"__s_{c}": F.coalesce(F.sum(d).over(running), F.lit(0.0)), f"__q_{c}": F.coalesce(F.sum(d * d).over(running), F.lit(0.0))}
    x = x.withColumns(own)
    x = x.withColumns({f"__{k}_{c}_{r}": F.col(f"__{k}_{c}") - F.coalesce(F.lag(f"__{k}_{c}", r).over(w), F.lit(0)) for c in cols for k in "nsq" for r in cols[c]})
    out = {}
    for c in cols:
        for r in cols[c]:
            n, s, q = (F.col(f"__{k}_{c}_{r}") for k in "nsq")
            out[f"{c}_count_{r}"] = n
            out[f"{c}_mean_{r}"] = F.when(n > 0, F.col(f"__mid_{c}") + s / n)
            m2 = q - s * s / n
            out[f"{c}_m2_{r}"] = F.when(n > 0, F.when(m2 > 1e-13 * F.col(f"__q_{c}"), m2).otherwise(0.0))  # below, the difference of running sums is rounding
    return x.withColumns(out).drop(*[f"__mid_{c}" for c in cols], *own, *[f"__{k}_{c}_{r}" for c in cols for k in "nsq" for r in cols[c]])


def frame_slopes(x: DataFrame, w, col: str | Sequence[str], rows: tuple[int, ...]) -> DataFrame:
    """Least-squares slope of ``col`` against the row number ``n`` over the last rows of each frame size: col_slope_r, null where fewer than two have a value.

    From moments of the number and of its product with the value, both taken
    from the chunk's middle, so sums stay small. Several columns share the
    windows.
    """
    cols = [col] if isinstance(col, str) else list(col)
    all_of = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i = (F.col("n") - F.avg("n").over(all_of)).cast("double")
    x = x.withColumns({"__at": i, **{f"__base_{c}": F.coalesce(F.avg(c).over(all_of), F.lit(0.0)) for c in cols}})
    parts = {}
    for c in cols:
        y = F.col(c) - F.col(f"__base_{c}")
        parts |= {f"__i_{c}": F.when(F.col(c).isNotNull(), F.col("__at")), f"__y_{c}": y, f"__z_{c}": F.col("__at") * y}
    x = frame_sums(x.withColumns(parts), w, list(parts), rows)
    out = {}
    for c in cols:
        for r in rows:
            of = lambda k, m: F.col(f"__{k}_{c}_{m}_{r}")  # noqa: B023, E731
            out[f"{c}_slope_{r}"] = F.when(of("i", "count") > 1, F.try_divide((of("z", "mean") - of("i", "mean") * of("y", "mean")) * of("i", "count"), of("i", "m2")))
    return x.withColumns(out).drop("__at", *[f"__base_{c}" for c in cols], *parts, *[f"{p}_{m}_{r}" for p in parts for m in ("count", "mean", "m2") for r in rows])


def carried_max(rows: DataFrame, keys: list[str], col: str) -> DataFrame:
    """(keys, chunk, before): the greatest ``col`` of earlier chunks; a row for each chunk."""
    each = rows.groupBy(*keys, "chunk").agg(F.max(col).alias("__m"))
    return each.select(*keys, "chunk", F.max("__m").over(Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))


def asof(left: DataFrame, right: DataFrame, cols: list[str], ts: str = "ts_ns", seq: str = "seq", stretch: int = STRETCH, by: Sequence[str] = ()) -> DataFrame:
    """Left rows with the columns ``cols`` of the last right row of their key ``by`` at or before them (null if none)."""
    return asof_all(left, [(right, cols)], ts, seq, stretch, by)


def asof_all(left: DataFrame, rights: Sequence[tuple[DataFrame, list[str]]], ts: str = "ts_ns", seq: str = "seq", stretch: int = STRETCH, by: Sequence[str] = (), times: DataFrame | None = None) -> DataFrame:
    """The same for several right sides, each with its columns, in one pass over the left rows.

    All sides meet by key and stretch of time; what a stretch begins with is
    the last state of the key's earlier stretches, one row for each of them.
    ``times`` are the left rows' keys and times, if they come cheaper than from
    the left rows themselves.
    """
    by, day = list(by), F.floor(F.col(ts) / stretch)
    places = range(len(rights))
    states = [F.struct(*cols) for _, cols in rights]
    none = {f"__state{i}": F.lit(None).cast(r.select(s.alias("s")).schema["s"].dataType) for i, ((r, _), s) in enumerate(zip(rights, states, strict=True))}
    x = left.withColumns({"__day": day, "__kind": F.lit(1), **none})
    days = (left if times is None else times).select(*by, day.alias("__day")).distinct()
    for i, (right, _) in enumerate(rights):
        v = right.select(*by, F.col(ts), F.col(seq), day.alias("__day"), F.lit(0).alias("__kind"), states[i].alias(f"__state{i}"))
        days = days.join(v.groupBy(*by, "__day").agg(F.max_by(f"__state{i}", F.struct(ts, seq)).alias(f"__end{i}")), [*by, "__day"], "full")
        x = x.unionByName(v, allowMissingColumns=True)
    before = Window.partitionBy(*by).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*by, "__day", *[F.last(f"__end{i}", True).over(before).alias(f"__before{i}") for i in places])
    own = Window.partitionBy(*by, "__day").orderBy(ts, "__kind", seq).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({f"__own{i}": F.last(f"__state{i}", True).over(own) for i in places})
    x = x.where("__kind = 1").join(days, [*by, "__day"], "left")
    at = [F.coalesce(f"__own{i}", f"__before{i}") for i in places]
    return x.select(*left.columns, *[at[i][c].alias(c) for i, (_, cols) in enumerate(rights) for c in cols])


def scan(df: DataFrame, keys: list[str], step: Column, then: Callable[[Column, Column], Column], move: Callable[[Column, Column], Column], start: Column, fan: int = FAN) -> DataFrame:
    """Numbered rows with ``before`` and ``after``, the states that their key is in, from ``start`` on.

    ``step`` is what a row does to the state, as a value that composes:
    ``then(f, g)`` is f followed by g, ``move(state, f)`` the state after f. A
    chunk of ``fan`` steps is composed to one; those steps are scanned in the
    same way, which gives each chunk's entry state; then it is replayed. No
    task sees more than a chunk of a key, and all is columns.
    """
    size = df.agg(F.max("n")).first()[0] or 0
    row = F.struct(*df.columns)
    return _scanned(df.select(*keys, "n", row.alias("__row"), step.alias("__step")), keys, then, move, start, fan, size).select(*[F.col(f"__row.{c}").alias(c) for c in df.columns], "before", "after")


def _scanned(x: DataFrame, keys: list[str], then, move, start: Column, fan: int, size: int) -> DataFrame:
    chunk = F.floor((F.col("n") - 1) / fan).alias("__chunk")
    lists = x.groupBy(*keys, chunk).agg(F.array_sort(F.collect_list(F.struct("n", "__row", "__step"))).alias("__rows"))
    if size > fan:
        lists = stored(lists, "scan")
        rest = F.slice("__rows", 2, fan)
        whole = F.aggregate(rest, F.element_at("__rows", 1)["__step"], lambda acc, r: then(acc, r["__step"]))
        sums = lists.select(*keys, (F.col("__chunk") + 1).alias("n"), F.lit(0).alias("__row"), whole.alias("__step"))
        entry = _scanned(sums, keys, then, move, start, fan, -(-size // fan)).select(*keys, (F.col("n") - 1).alias("__chunk"), F.col("before").alias("__entry"))
        lists = lists.join(entry, [*keys, "__chunk"])
    else:
        lists = lists.withColumn("__entry", start)
    states = F.aggregate("__rows", F.array("__entry"), lambda acc, r: F.array_append(acc, move(F.element_at(acc, -1), r["__step"])))
    out = lists.select(*keys, "__rows", states.alias("__states")).select(*keys, F.explode(F.arrays_zip("__rows", F.slice("__states", 1, F.size("__rows")).alias("__from"), F.slice("__states", 2, F.size("__rows")).alias("__to"))).alias("__z"))
    return out.select(*keys, F.col("__z.__rows.n").alias("n"), F.col("__z.__rows.__row").alias("__row"), F.col("__z.__from").alias("before"), F.col("__z.__to").alias("after"))


def recent(left: DataFrame, right: DataFrame, sums: dict[str, Column], span: int, ts: str = "ts_ns", by: Sequence[str] = ()) -> DataFrame:
    """Left rows with sums over the right rows of their key ``by`` of the last ``span`` nanoseconds (both ends included).

    A right row goes to its own span of time and to the next, so windows are
    over spans, not over all time. A sum is that of all rows so far less that
    of the rows before the frame, both of which are carried on from row to
    row, however many rows a span holds; so values must be finite.
    """
    at, by = F.floor(F.col(ts) / span), list(by)
    u = left.withColumns({"__at": at, "__kind": F.lit(1), **{c: F.lit(None).cast("double") for c in sums}})
    v = right.select(*by, ts, F.explode(F.array(at, at + 1)).alias("__at"), F.lit(0).alias("__kind"), *[e.cast("double").alias(c) for c, e in sums.items()])
    w = Window.partitionBy(*by, "__at").orderBy(ts)
    so_far, gone = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(Window.unboundedPreceding, -span - 1)
    x = u.unionByName(v, allowMissingColumns=True).withColumns({c: F.coalesce(F.sum(c).over(so_far), F.lit(0.0)) - F.coalesce(F.sum(c).over(gone), F.lit(0.0)) for c in sums})
    return x.where("__kind = 1").select(*left.columns, *sums)


def lagged(df: DataFrame, keys: list[str], cols: dict[str, Column]) -> DataFrame:
    """Numbered rows with values of their key's row before (null at the first)."""
    x = haloed(df.withColumns({f"__x_{o}": c for o, c in cols.items()}), halo=1)
    w = Window.partitionBy(*keys, "chunk").orderBy("n")
    return x.withColumns({o: F.lag(f"__x_{o}").over(w) for o in cols}).where("own").drop("chunk", "own", *[f"__x_{o}" for o in cols])


def runs(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Numbered rows with ``begin``, the number of the first row of their run of equal values."""
    x = lagged(df.withColumn("__v", value), keys, {"__before": F.col("__v")})
    new = F.when((F.col("n") == 1) | ~F.col("__v").eqNullSafe(F.col("__before")), F.col("n"))
    return running_max(x.withColumn("__new", new), keys, "__new", "begin").drop("__v", "__before", "__new")


def tiled(df: DataFrame, keys: list[str], groups: int, out: str) -> DataFrame:
    """Numbered rows in ``groups`` contiguous groups per key, as equal as can be (the first ones longer), from numbers and counts.

    A key's count, one row for each key, goes to the rows: rows that were
    dealt out by few keys would be as few tasks.
    """
    x = df.join(F.broadcast(df.groupBy(*keys).agg(F.max("n").alias("__rows"))), keys)
    each, more = F.floor(F.col("__rows") / groups), F.col("__rows") % groups
    long, at = more * (each + 1), F.col("n") - 1
    return x.withColumn(out, F.when(at < long, F.floor(at / (each + 1)) + 1).otherwise(more + F.floor((at - long) / F.greatest(each, F.lit(1))) + 1).cast("int")).drop("__rows")


def ema(df: DataFrame, keys: list[str], cols: dict[str, tuple[str, float]], alpha: float, block: int | None = None) -> DataFrame:
    """Exponential means e += alpha (x - e) of numbered rows: name -> (column, start); alpha between 0 and 1.

    Within a block by running sums; what blocks before leave weighs
    (1 - alpha) ** block each. The block is as long as alpha allows without
    overflow, and as many blocks are carried as doubles can see.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    keep = 1 - alpha
    loss = -math.log1p(-alpha)  # of a row, as a logarithm
    block = max(1, min(block or max(BLOCK, math.ceil(UNSEEN / 3 / loss)), LONGEST, int(LARGEST / loss)))
    carried = math.ceil(UNSEEN / (loss * block))
    i = F.col("__i")
    x = df.withColumns({"__block": F.floor((F.col("n") - 1) / block), "__i": (F.col("n") - 1) % block + 1})
    ends = x.groupBy(*keys, "__block").agg(*[F.sum(alpha * F.pow(F.lit(keep), block - i) * F.col(c)).alias(f"__end_{o}") for o, (c, _) in cols.items()])
    ends = ends.withColumn("__d", F.explode(F.sequence(F.lit(1), F.lit(carried))))
    carry = ends.groupBy(*keys, (F.col("__block") + F.col("__d")).alias("__block")).agg(*[F.sum(F.col(f"__end_{o}") * F.pow(F.lit(keep), block * (F.col("__d") - 1))).alias(f"__carry_{o}") for o in cols])
    w = Window.partitionBy(*keys, "__block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(carry, [*keys, "__block"], "left")
    return x.withColumns({
        o: alpha * F.pow(F.lit(keep), i) * F.sum(F.col(c) * F.pow(F.lit(keep), -i)).over(w) + F.pow(F.lit(keep), i) * F.coalesce(f"__carry_{o}", F.lit(0.0)) + start * F.pow(F.lit(keep), F.col("n"))
        for o, (c, start) in cols.items()
    }).drop("__block", "__i", *[f"__carry_{o}" for o in cols])


def running(df: DataFrame, keys: list[str], sums: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """Numbered rows with running sums: a chunk's own, and the total of the chunks before."""
    x = df.withColumns({"__chunk": F.floor((F.col("n") - 1) / chunk), **{f"__x_{o}": c for o, c in sums.items()}})
    each = x.groupBy(*keys, "__chunk").agg(*[F.sum(f"__x_{o}").alias(f"__t_{o}") for o in sums])
    over = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select(*keys, "__chunk", *[F.coalesce(F.sum(f"__t_{o}").over(over), F.lit(0)).alias(f"__b_{o}") for o in sums])
    w = Window.partitionBy(*keys, "__chunk").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(before, [*keys, "__chunk"]).withColumns({o: F.sum(f"__x_{o}").over(w) + F.col(f"__b_{o}") for o in sums})
    return x.drop("__chunk", *[f"__{k}_{o}" for k in "xb" for o in sums])


def carried_last(df: DataFrame, keys: list[str], col: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """Numbered rows with the last non-null ``col`` so far."""
    x = df.withColumn("__chunk", F.floor((F.col("n") - 1) / chunk))
    each = x.groupBy(*keys, "__chunk").agg(F.max_by(col, F.when(F.col(col).isNotNull(), F.col("n"))).alias("__end"))
    over = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select(*keys, "__chunk", F.last("__end", True).over(over).alias("__before"))
    w = Window.partitionBy(*keys, "__chunk").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return x.join(before, [*keys, "__chunk"]).withColumn(out, F.coalesce(F.last(col, True).over(w), F.col("__before"))).drop("__chunk", "__before")


def running_max(df: DataFrame, keys: list[str], col: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """Numbered rows with the greatest ``col`` so far."""
    x = df.withColumn("chunk", F.floor((F.col("n") - 1) / chunk))
    w = Window.partitionBy(*keys, "chunk").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return x.join(carried_max(x, keys, col), [*keys, "chunk"]).withColumn(out, F.greatest(F.max(col).over(w), "before")).drop("chunk", "before")
