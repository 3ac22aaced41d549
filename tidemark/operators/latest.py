"""The delivery that holds: one row per identifier, the one with the greatest version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_version(df: DataFrame, key: str, version: Column, columns: dict[str, Column]) -> DataFrame:
    """One row per ``key``: ``columns`` of the row with the greatest ``version``.

    A row whose key is NULL has no identity and stands for itself: such rows take no part in the grouping and are added
    to it. A NULL version is the least. Among equal versions the row that is greatest column by column (NULL
    least) holds, so the result doesn't depend on the order of rows. The maximum is combined before the
    shuffle, so a key that holds much of the table sends one row per task.
    """
    packed = F.struct(version.alias("__version"), *[c.alias(n) for n, c in columns.items()])
    named = F.col(key).isNotNull()
    held = df.filter(named).select(F.col(key), packed.alias("__row")).groupBy(key).agg(F.max("__row").alias("__row"))
    held = held.select(key, *[F.col("__row")[n].alias(n) for n in columns])
    return held.unionByName(df.filter(~named).select(F.col(key), *[c.alias(n) for n, c in columns.items()]))
