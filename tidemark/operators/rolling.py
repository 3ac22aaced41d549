"""Totals and averages over trailing days, silent days included, by binary doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_totals(df: DataFrame, entity: str, day: Column, measures: dict[str, Column]) -> DataFrame:
    """One row per entity and active day; rows with unknown entity or day belong to none."""
    rows = df.select(F.col(entity), day.alias("day"), *[c.alias(n) for n, c in measures.items()]).filter(F.col(entity).isNotNull() & F.col("day").isNotNull())
    return rows.groupBy(entity, "day").agg(*[F.sum(n).alias(n) for n in measures])


def with_silent_days(daily: DataFrame, entity: str, measures: Sequence[str]) -> DataFrame:
    """Adds the days between two active days, with zeros, and for each day the active days around it.

    ``prev_day`` is the last active day up to this one, ``next_day`` the first active day after it (NULL on
    the last day). Each active day makes the silent days that follow it, so there is no join and no calendar.
    """
    by = Window.partitionBy(entity).orderBy("day")
    spread = daily.withColumn("next_day", F.lead("day").over(by)).withColumn("__d", F.explode(F.sequence(F.col("day"), F.coalesce(F.col("next_day") - 1, F.col("day")))))
    active = F.col("__d") == F.col("day")
    return spread.select(entity, F.col("__d").alias("day"), F.col("day").alias("prev_day"), "next_day", *[F.when(active, F.coalesce(F.col(m), F.lit(0))).otherwise(F.lit(0)).cast("long").alias(m) for m in measures])


def rolling_totals(dense: DataFrame, entity: str, measures: Sequence[str], windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Totals ``{m}_{w}d`` and averages ``{m}_avg_{w}d`` over the last w days of a table without missing days.

    Sums of 1, 2, 4, 8, ... days are built by adding a block to itself shifted by its length; a window is the
    sum of the blocks of its binary form, each shifted past the longer ones. Days before the entity's first
    day count as 0, and an average divides by w. All shifts are lags over one ordering, so one shuffle by
    entity and one sort serve every window; the sort spills, and an entity has at most one row a day.
    """
    if any(w < 1 for w in windows):
        raise ValueError("a window has at least one day")
    by = Window.partitionBy(entity).orderBy("day")
    shifted = lambda name, days: F.coalesce(F.lag(name, days).over(by), F.lit(0).cast("long")) if days else F.col(name)
    out = dense.withColumns({f"__{m}_1": F.col(m) for m in measures})
    block = 1
    while 2 * block <= max(windows):
        out = out.withColumns({f"__{m}_{2 * block}": F.col(f"__{m}_{block}") + shifted(f"__{m}_{block}", block) for m in measures})
        block *= 2
    totals = {}
    for w in windows:
        parts = [1 << i for i in reversed(range(w.bit_length())) if w >> i & 1]
        for m in measures:
            at, total = 0, None
            for p in parts:
                term = shifted(f"__{m}_{p}", at)
                total, at = term if total is None else total + term, at + p
            totals[f"{m}_{w}d"] = total
    out = out.withColumns(totals)
    out = out.withColumns({f"{m}_avg_{w}d": F.col(f"{m}_{w}d") / F.lit(float(w)) for w in windows for m in measures})
    return out.drop(*[c for c in out.columns if c.startswith("__")])
