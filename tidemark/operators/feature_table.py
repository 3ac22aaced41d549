"""Per-entity feature tables over many event types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.timeutil import DAY_US

MEASURES = ("clicks", "since_last_s", "clicks_7d", "clicks_30d")


def event_counts(events: DataFrame, entity: str, types: Sequence[str], time_us: str, as_of_us: int) -> DataFrame:
    """The compact long table: one row per entity and combination of ``types``.

    ``clicks`` counts all events, ``clicks_7d``/``clicks_30d`` those of the 7 or 30 days that end with
    ``as_of_us``, ``last_us`` is the time of the last event not after it (NULL if none has a known time).
    Events without entity are left out; a NULL type stays a combination of its own. The counts are combined before the shuffle,
    so it moves at most one row per task and (entity, types), however often an entity occurs.
    """
    age = F.lit(as_of_us).cast("long") - F.col(time_us)
    within = lambda days: F.sum(F.when((age >= 0) & (age < days * DAY_US), 1).otherwise(0))
    return (
        events.filter(F.col(entity).isNotNull())
        .groupBy(entity, *types)
        .agg(F.count(F.lit(1)).alias("clicks"), F.max(F.when(age >= 0, F.col(time_us))).alias("last_us"), F.min(time_us).alias("first_us"), within(7).alias("clicks_7d"), within(30).alias("clicks_30d"))
    )


def type_list(events: DataFrame, column: str, limit: int = 4096) -> list:
    """The distinct known values of a type column, sorted.

    The list becomes columns, so it must stay short: more than ``limit`` values are an error, none is dropped.
    """
    found = [r[0] for r in events.select(column).filter(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} values; pass the types that shall be columns, or use the long table")
    return sorted(found)


def since_seconds(as_of_us: int, last_us: Column) -> Column:
    return (F.lit(as_of_us).cast("long") - last_us) / F.lit(1_000_000.0)


def feature_table(counts: DataFrame, entity: str, major: str, minor: str, majors: Sequence, as_of_us: int) -> DataFrame:
    """One row per entity from the long table over (entity, major, minor).

    Columns: the entity; totals over all its events (``clicks``, ``since_last_s``, ``first_us``, ``last_us``,
    ``clicks_7d``, ``clicks_30d``); for each ``a`` in ``majors`` a column ``{major}_{a}`` with the four ``MEASURES``
    as a struct (NULL where the entity has no such event); and the map ``{major}_{minor}`` from "major:minor"
    to the same measures for each pair of known values that the entity has.

    The pivot is a projection by the explicit list out of one compact map per entity. So only the long table
    is shuffled, by the entity; the wide rows never are, and no group is larger than the number of pairs.
    """
    total = [F.sum("clicks").alias("clicks"), F.max("last_us").alias("last_us"), F.min("first_us").alias("first_us"), F.sum("clicks_7d").alias("clicks_7d"), F.sum("clicks_30d").alias("clicks_30d")]
    measures = lambda: F.struct("clicks", since_seconds(as_of_us, F.col("last_us")).alias("since_last_s"), "clicks_7d", "clicks_30d")
    pair = F.when(F.col(major).isNotNull() & F.col(minor).isNotNull(), F.struct(F.concat_ws(":", F.col(major), F.col(minor)).alias("key"), measures().alias("value")))
    by_major = (
        counts.repartition(entity)
        .withColumn("__pair", pair)
        .groupBy(entity, major)
        .agg(*total, F.collect_list("__pair").alias("__pairs"))
    )
    known = F.when(F.col(major).isNotNull(), F.struct(F.col(major).alias("key"), measures().alias("value")))
    per = by_major.groupBy(entity).agg(*total, F.collect_list(known).alias("__m"), F.flatten(F.collect_list("__pairs")).alias("__p"))
    per = per.select(entity, *[c for c in ("clicks", "first_us", "last_us", "clicks_7d", "clicks_30d")], since_seconds(as_of_us, F.col("last_us")).alias("since_last_s"), F.map_from_entries("__m").alias("__m"), F.map_from_entries("__p").alias(f"{major}_{minor}"))
    wide = [f"__m[{_literal(a)}] AS `{major}_{a}`" for a in majors]
    return per.selectExpr(*[f"`{c}`" for c in per.columns if c != "__m"], *wide)


def _literal(value) -> str:
    return str(value) if isinstance(value, int) else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
