"""Clicks of a delivery table: the delivery that holds, with stand-ins for unknown values turned into NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.latest import latest_version
from tidemark.timeutil import micros

#: Fixed values of the data model: a device and a time that stand for "unknown".
UNKNOWN_DEVICE, UNKNOWN_TIME_US = -1, 0


def known(df: DataFrame, name: str) -> Column:
    """Column ``name`` with its stand-in for unknown as NULL; a time as epoch microseconds."""
    if name == "device":
        return F.nullif(F.col(name), F.lit(UNKNOWN_DEVICE))
    if name == "click_time":
        return F.nullif(micros(df, name), F.lit(UNKNOWN_TIME_US).cast("long"))
    return F.col(name)


def clicks(deliveries: DataFrame, *columns: str) -> DataFrame:
    """One row per click with ``columns``; ``click_time`` comes as epoch microseconds in ``time_us``.

    Only the columns asked for are read and shuffled. Values are cleaned after the choice of the delivery,
    so a blank in the last delivery isn't filled from an earlier one.
    """
    taken = {("time_us" if c == "click_time" else c): known(deliveries, c) for c in columns}
    return latest_version(deliveries, "click_id", micros(deliveries, "ingest_time"), taken)
