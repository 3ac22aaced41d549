"""Features of rows as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import Feature, request_features
from tidemark.operators.frames import Frame
from tidemark.operators.preagg import build_buckets


def serve_requests(stream: DataFrame, history: Callable[[], DataFrame], frames: Sequence[tuple[Frame, Sequence[Feature]]], sink: Callable[[DataFrame, int], None]):
    """A writer that answers each micro-batch of requests from the history as it is then."""

    def answer(batch: DataFrame, number: int) -> None:
        sink(request_features(batch, history(), frames), number)

    return stream.writeStream.foreachBatch(answer)


def live_sessions(stream: DataFrame, keys: Sequence[str], time: str, gap: str, late: str) -> DataFrame:
    """Sessions of a stream: keyed timers in Spark's state store, one open session per key and gap.

    An event opens its key's session or moves its end; when the watermark (``late`` behind the newest event)
    has passed the last event by ``gap``, the session is given out and its state dropped. Events with an unknown key or time
    are left out. Events of one session are combined in each task before the shuffle.
    """
    known = F.col(time).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    rows = stream.filter(known).withWatermark(time, late)
    timer = F.session_window(time, gap)
    return rows.groupBy(*keys, timer.alias("session")).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("events")).select(*keys, "start", "end", "events")


def live_buckets(stream: DataFrame, keys: Sequence[str], time: str, value: str, bucket_ms: int, path: str):
    """A writer that adds each micro-batch's bucket totals to the files at ``path``.

    The totals are partial results: ``merge_buckets`` puts them together on reading, so late rows need no rewriting.
    A batch that is repeated after a failure overwrites its own folder.
    """

    def add(batch: DataFrame, number: int) -> None:
        build_buckets(batch, keys, time, F.col(value), bucket_ms).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add)


def first_deliveries(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key's first row; the state of a key is dropped once the watermark has passed it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
