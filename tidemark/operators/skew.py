"""Per-key results when a handful of keys holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sketches of tasks are merged by this many tasks first, and then by one.
MERGERS = 64


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """The keys that may hold at least ``share`` of the rows, with an estimated count; NULL is a key like any other.

    One pass with a mergeable frequent-items sketch per task, of 16/share counters: its counts are exact to within a
    quarter of the share, so every key at or above ``share`` is among the result, others may be. At most
    ``2/share`` keys come back, whatever the table holds; that is the bound on which the broadcast of them rests.
    """
    if not 0.0001 <= share <= 1:
        raise ValueError("share must be between 0.0001 and 1")
    most, tracked = int(2 / share), 1 << (int(16 / share) - 1).bit_length()
    # a NULL part is left out of the JSON and read back as NULL
    items = df.select(F.to_json(F.struct(*keys)).alias("k"), F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("m"))
    parts = items.groupBy("m").agg(F.expr(f"approx_top_k_accumulate(k, {tracked})").alias("s"))
    found = parts.groupBy((F.col("m") * 0).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s")).select(F.explode(F.expr(f"approx_top_k_estimate(s, {most})")).alias("t"))
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return found.select(F.from_json(F.col("t.item"), schema).alias("k"), F.col("t.count").alias("estimate")).select("k.*", "estimate")


def skewed_groups(df: DataFrame, keys: Sequence[str], distinct: str, aggregates: dict[str, tuple[str, Column]], share: float = 0.005) -> DataFrame:
    """Results per key over all rows, heavy and light keys computed apart and put together.

    Heavy keys are found by ``heavy_keys`` and collected (at most ``2/share`` of them). Their rows are picked by a
    broadcast join with that list. They are combined in each task and shuffled by (key, ``distinct`` column), so that column is
    the salt: one key's rows go to all tasks, and what is left of them to one row per task and key. All other rows go through one
    ordinary shuffle by key, in which no key has more than ``share`` of them. NULL is a key of its own, heavy where it is frequent;
    a NULL in the ``distinct`` column is no value, and such rows of a heavy key are combined before the shuffle.

    ``aggregates``: output name -> (kind, column), kind one of ``sum``, ``min``, ``max``, ``count`` (of rows
    with the column known). ``rows`` counts rows and ``distinct_<column>`` the distinct known values, exactly.
    ``heavy`` tells which way a key went. An empty table gives an empty result.
    """
    found = heavy_keys(df, keys, share).collect()
    spark, named = df.sparkSession, f"distinct_{distinct}"
    heavy = F.broadcast(spark.createDataFrame([tuple(r[k] for k in keys) for r in found], df.select(*[F.col(k).alias(f"__h_{k}") for k in keys]).schema))
    on = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys))
    again = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}
    first = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    rows = df.select(*keys, F.col(distinct).alias("__d"), *[c.alias(f"__a_{n}") for n, (_, c) in aggregates.items()])
    partial = [F.count(F.lit(1)).alias("rows"), *[first[kind](f"__a_{n}").alias(n) for n, (kind, _) in aggregates.items()]]

    spread = rows.join(heavy, on, "left_semi").groupBy(*keys, "__d").agg(*partial)
    hot = spread.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.count("__d").alias(named), *[again[kind](n).alias(n) for n, (kind, _) in aggregates.items()])
    rest = rows.join(heavy, on, "left_anti").repartition(*keys)
    light = rest.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("__d").alias(named), *partial[1:])
    return hot.withColumn("heavy", F.lit(True)).unionByName(light.withColumn("heavy", F.lit(False)))
