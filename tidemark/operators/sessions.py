"""Sessions: runs of events of one key without a pause longer than a gap, by keyed timers.

A session is state of its key in Spark's state store: ordered events open it and move its end, which is its timer; when the
stream's time has passed the end, the timer has run out, start, end and number are given out and the state is dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.streaming.replay import replay
from tidemark.timeutil import DAY_US, floor_div

#: A stream's time begins at 1970; the timers run on time shifted by 4 000 years, so that earlier events aren't late.
SHIFT_US = 4000 * 365 * DAY_US


def fragments(events: DataFrame, keys: Sequence[str], time_us: str, gap_us: int) -> DataFrame:
    """Events of a key within one slot of the length of the gap, as one row: first, last and number.

    Two events of a slot are less than a gap apart, so no session is torn. It is an ordinary aggregate that
    is combined before the shuffle: a key with a third of all events sends one row per task and slot.
    """
    known = F.col(time_us).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    slot = floor_div(F.col(time_us), gap_us).alias("__slot")
    return events.filter(known).groupBy(*keys, slot).agg(F.min(time_us).alias("first_us"), F.max(time_us).alias("last_us"), F.count(F.lit(1)).alias("events")).drop("__slot")


def session_timers(stream: DataFrame, keys: Sequence[str], gap_us: int) -> DataFrame:
    """The streaming operator: sessions of a stream of ``fragments``, each given out when its timer has run out.

    The timer of a session stands one gap after its last event; a fragment at that very moment still meets it. Time is that of the
    newest fragment: the stream must come in order of time, slice by slice.
    """
    rows = stream.withColumn("__at", F.timestamp_micros(F.col("first_us") + SHIFT_US)).withWatermark("__at", "0 seconds")
    timer = F.make_interval(secs=((F.col("last_us") - F.col("first_us") + gap_us) / F.lit(1_000_000)).cast("decimal(18,6)"))
    held = rows.groupBy(*keys, F.session_window("__at", timer).alias("__session")).agg(F.min("first_us").alias("start_us"), F.max("last_us").alias("end_us"), F.sum("events").alias("events"))
    return held.select(*keys, "start_us", "end_us", "events")


def sessions(events: DataFrame, keys: Sequence[str], time_us: str, gap_us: int, slice_us: int = 7 * DAY_US) -> DataFrame:
    """Sessions of a table: ``keys``, ``start_us``, ``end_us`` (first and last event), ``duration_s``, ``events``.

    The table's fragments are replayed in order of time through ``session_timers``, a slice of ``slice_us`` at a time, and a last
    row far behind them lets all timers run out. State holds the sessions of one slice; a hot key has one fragment per slot in it.
    A pause of exactly ``gap_us`` doesn't end a session. Events with an unknown key part or time belong to none; equal
    events are events of their own. A session that crosses slices is one session, as its state waits for the next slice.
    """
    part = fragments(events, keys, time_us, gap_us)

    def last(number: int) -> DataFrame:
        at = (number + 2) * slice_us + 2 * gap_us + 1_000_000  # a stream keeps its time in milliseconds
        return part.sparkSession.range(1).select(*[F.lit(None).cast(part.schema[k].dataType).alias(k) for k in keys], F.lit(at).alias("first_us"), F.lit(at).alias("last_us"), F.lit(0).alias("events"))

    found = replay(part, floor_div(F.col("first_us"), slice_us), lambda rows: session_timers(rows, keys, gap_us), last)
    return found.select(*keys, "start_us", "end_us", ((F.col("end_us") - F.col("start_us")) / F.lit(1_000_000.0)).alias("duration_s"), "events")
