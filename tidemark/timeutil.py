"""Epoch arithmetic on timestamps that does not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_US = 86_400_000_000
_UTC = {"UTC", "ETC/UTC", "GMT", "Z", "+00:00"}


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch of column ``name``; NULL stays NULL.

    A timestamp without zone is read as UTC, a date as its midnight, an integer as milliseconds.
    """
    col, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        if df.sparkSession.conf.get("spark.sql.session.timeZone").upper() in _UTC:
            return F.unix_micros(col.cast("timestamp"))
        # the interval since the epoch has no zone, so no clock change can shift it
        span = col - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        day, hour, minute = (F.extract(F.lit(p), span).cast("long") for p in ("DAY", "HOUR", "MINUTE"))
        second = (F.extract(F.lit("SECOND"), span) * 1_000_000).cast("long")
        return ((day * 24 + hour) * 60 + minute) * 60_000_000 + second
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("long") * DAY_US
    return col.cast("long") * 1000


def floor_div(col: Column, by: int) -> Column:
    """Integer division rounding down, exact over the whole range of bigint."""
    return F.call_function("div", col - F.pmod(col, F.lit(by).cast("long")), F.lit(by).cast("long"))


def millis(df: DataFrame, name: str) -> Column:
    """Milliseconds since the epoch (rounded down)."""
    if isinstance(df.schema[name].dataType, T.IntegralType):
        return F.col(name).cast("long")
    return floor_div(micros(df, name), 1000)


def day_number(us: Column) -> Column:
    """UTC days since the epoch, of epoch microseconds."""
    return floor_div(us, DAY_US).cast("int")
