"""Long windows from buckets: totals of whole buckets are kept, only the edge is read row by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.timeutil import floor_div, millis

#: How partial results of a bucket are put together.
MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}

#: So many buckets of the greatest length are looked up one by one.
FEW = 16


def _partials(value: Column) -> list[Column]:
    return [F.count(value).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max")]


def build_buckets(rows: DataFrame, keys: Sequence[str], time: str, value: Column, bucket_ms: int, where: Column | None = None) -> DataFrame:
    """Count, sum, minimum and maximum of ``value`` per key and bucket of time (of rows with a true ``where``).

    Combined before the shuffle; late rows are new partial results, which ``merge_buckets`` adds.
    """
    rows = rows if where is None else rows.filter(where)
    return rows.groupBy(*keys, floor_div(millis(rows, time), bucket_ms).alias("bucket")).agg(*_partials(value)).filter("bucket IS NOT NULL")


def merge_buckets(*tables: DataFrame) -> DataFrame:
    """One bucket table out of partial ones over the same keys."""
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    keys = [c for c in whole.columns if c not in MERGE]
    return whole.groupBy(*keys).agg(*[f(c).alias(c) for c, f in MERGE.items()])


def _levels(buckets: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """Buckets of one, two, four, ... times the length, up to ``2 ** most``, as ``level`` and ``bucket``; combined before the one shuffle they take."""
    every = buckets.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("bucket", F.expr("shiftright(bucket, level)"))
    return every.groupBy(*keys, "level", "bucket").agg(*[f(c).alias(c) for c, f in MERGE.items()])


def _cover(first: Column, last: Column, most: int) -> Column:
    """The fewest buckets of ``_levels`` that cover those from ``first`` to ``last``, at most two a level: an array of level and bucket."""
    none = F.array().cast("array<struct<level:int,bucket:bigint>>")
    place = lambda level, b: F.array(F.struct(level.alias("level"), b.cast("long").alias("bucket")))

    def step(a: Column, level: Column) -> Column:
        low, high = a["low"], a["high"]
        final = level == most  # whatever is left lies in whole buckets of the greatest length
        left = (low <= high) & ~final & (F.pmod(low, F.lit(2)) == 1)
        right = (low <= high) & ~final & (F.pmod(high, F.lit(2)) == 0) & ~(left & (low == high))
        some = F.when(left, place(level, low)).otherwise(none)
        more = F.when(right, place(level, high)).otherwise(none)
        rest = F.when(final & (low <= high), F.transform(F.sequence(low, high), lambda b: F.struct(level.alias("level"), b.alias("bucket")))).otherwise(none)
        low, high = F.when(left, low + 1).otherwise(low), F.when(right, high - 1).otherwise(high)
        halved = lambda c: F.shiftright(c, 1)
        # an empty rest stays empty: halving could make it look like one bucket
        empty = low > high
        return F.struct(F.when(empty, F.lit(1)).otherwise(halved(low)).cast("long").alias("low"), F.when(empty, F.lit(0)).otherwise(halved(high)).cast("long").alias("high"), F.concat(a["found"], some, more, rest).alias("found"))

    zero = F.struct(first.cast("long").alias("low"), last.cast("long").alias("high"), none.alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(most)), zero, step)["found"]


def long_window(requests: DataFrame, history: DataFrame, buckets: DataFrame, keys: Sequence[str], time: str, value: Column, window_ms: int, bucket_ms: int, where: Column | None = None) -> DataFrame:
    """Requests with ``count``, ``sum``, ``avg``, ``min`` and ``max`` over the history of their key in [time - window, time].

    Buckets wholly inside the window come from ``buckets``. Where a window has more than ``FEW`` of them they are put together to longer ones first,
    of which a request meets two of each length and ``FEW`` of the longest at most. In the two at its edges the requests take their place among the
    bucket's rows, and running totals of that bucket answer them; no pairs of requests and rows are built, and a hot key's work is
    split by bucket. Equal requests are computed once. A NULL key or time matches nothing.
    """
    asked = requests.select(*keys, millis(requests, time).alias("__t")).distinct()
    first, last = floor_div(F.col("__t") - window_ms, bucket_ms), floor_div(F.col("__t"), bucket_ms)
    most = (window_ms // bucket_ms // FEW).bit_length()
    if most:
        inner = asked.withColumn("__b", F.explode(_cover(first + 1, last - 1, most))).select(*keys, "__t", F.col("__b.level").alias("level"), F.col("__b.bucket").alias("bucket"))
        whole = inner.join(_levels(buckets, keys, most), [*keys, "level", "bucket"]).select(*keys, "__t", *MERGE)
    else:
        inner = asked.withColumn("bucket", F.explode(F.when(last - first > 1, F.sequence(first + 1, last - 1)).otherwise(F.array().cast("array<bigint>"))))
        whole = inner.join(buckets, [*keys, "bucket"]).select(*keys, "__t", *MERGE)

    rows = history if where is None else history.filter(where)
    none = F.lit(None).cast("bigint")
    rows = rows.select(*keys, millis(rows, time).alias("__at"), value.alias("__v"), none.alias("__t")).filter("__at IS NOT NULL")
    kind = rows.schema["__v"].dataType

    def placed(of: DataFrame, at: Column, side: int) -> DataFrame:
        return of.select(*keys, at.alias("__at"), F.lit(None).cast(kind).alias("__v"), "__t").withColumn("__side", F.lit(side))

    # each request stands at both ends of its window; where both lie in one bucket, once
    apart = asked if window_ms >= bucket_ms else asked.filter(first < last)
    every = rows.withColumn("__side", F.lit(0)).unionByName(placed(apart, F.col("__t"), 1)).unionByName(placed(apart, F.col("__t") - window_ms, 2))
    by = Window.partitionBy(*keys, "bucket")
    frames = [by.orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0), by.orderBy(F.col("__at").desc(), "__side").rowsBetween(Window.unboundedPreceding, 0)]
    if window_ms < bucket_ms:
        every = every.unionByName(placed(asked.filter(first == last), F.col("__t"), 3))
        frames.append(by.orderBy("__at").rangeBetween(-window_ms, 0))
    every = every.withColumn("bucket", floor_div(F.col("__at"), bucket_ms))

    def totals(frame: WindowSpec) -> Column:
        return F.struct(*[f("__v").over(frame).alias(n) for f, n in zip((F.count, F.sum, F.min, F.max), MERGE)])

    sides = [F.when(F.col("__side") == k, totals(f)) for k, f in enumerate(frames, 1)]
    edge = every.withColumn("__e", F.coalesce(*sides)).filter("__side > 0").select(*keys, "__t", "__e.*")
    whole = whole.unionByName(edge)
    found = whole.groupBy(*keys, "__t").agg(*[f(c).alias(c) for c, f in MERGE.items()])
    out = requests.withColumn("__t", millis(requests, time)).join(found, [*keys, "__t"], "left")
    return out.select(*requests.columns, F.coalesce("count", F.lit(0)).alias("count"), "sum", (F.col("sum") / F.nullif(F.col("count"), F.lit(0))).alias("avg"), "min", "max")
