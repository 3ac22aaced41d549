"""Retention: what a table still holds at a given time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.timeutil import millis

KINDS = ("absolute", "latest", "absorlat", "absandlat")


def retain(df: DataFrame, keys: Sequence[str], time: str, kind: str, now_ms: int, keep_ms: int = 0, keep_rows: int = 0, tie: Sequence[str] = ()) -> DataFrame:
    """Rows that retention keeps: those not older than ``keep_ms``, the newest ``keep_rows`` of each key, or a combination.

    ``absorlat``: a row goes when it is too old or has too many newer ones; ``absandlat``: when both. A limit of
    0 is no limit. A NULL time counts as oldest. "The newest n of each key" is a limit that Spark applies in
    every task before the shuffle, so a hot key moves n rows per task.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind of retention: {kind}")
    young = F.coalesce(millis(df, time) >= now_ms - keep_ms, F.lit(False)) if keep_ms and kind != "latest" else F.lit(True)
    if kind == "absolute" or not keep_rows:
        return df.filter(young) if kind != "absandlat" or keep_rows or not keep_ms else df
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(time).desc_nulls_last(), *[F.col(c).desc() for c in tie]))
    if kind == "absandlat":
        if not keep_ms:
            return df
        return df.withColumn("__rank", rank).filter(young | (F.col("__rank") <= keep_rows)).drop("__rank")
    # dropping the old first changes no rank that matters: newer rows are never dropped before older ones
    return df.filter(young).withColumn("__rank", rank).filter(F.col("__rank") <= keep_rows).drop("__rank")
