"""A stored table as a stream in order of time, so that operators with timers run over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import Folder, shared_folder

_SLICE = "__slice"
_ENDS = ("last", "after")


def replay(table: DataFrame, slice_number: Column, operator: Callable[[DataFrame], DataFrame], last: Callable[[int], DataFrame]) -> DataFrame:
    """What ``operator``, a streaming operator in append mode, gives out for the rows of ``table``.

    The table is written once in slices, and the slices are fed to the stream in ascending order, each when the one before
    is done; so state holds what a slice leaves open, not the whole table. ``last(number)`` gives rows (of the table's columns)
    that follow the greatest slice number and lie so late that all timers run out; their own state is never given out. They come twice: the
    first time they move the stream's time, the second time they make a batch in which the timers run out.

    The slices, the state's checkpoint and the result lie in the shared folder. A lost executor's tasks are repeated from there. It is an error
    if a row came too late to be counted or if state other than that of the last rows is left, so no row is lost silently.
    An empty table gives an empty result.
    """
    spark, folder = table.sparkSession, shared_folder(table.sparkSession, "replay")
    table.withColumn(_SLICE, slice_number).write.partitionBy(_SLICE).parquet(f"{folder}/staged")
    numbers = sorted(int(d.partition("=")[2]) for d in Folder(spark, f"{folder}/staged").directories() if d.startswith(f"{_SLICE}="))
    schema = table.schema
    incoming = Folder(spark, f"{folder}/incoming")
    incoming.make()
    if not numbers:
        return operator(spark.createDataFrame([], schema))
    rows = last(numbers[-1]).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema])
    for name in _ENDS:
        rows.coalesce(1).write.parquet(f"{folder}/{name}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(incoming.path)
    out = operator(stream)
    # state is kept in as many partitions as there are cores; a slice's timers run out with the next slice, so no batch without rows is needed
    wanted = {"spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism), "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        writer = out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        query = writer.trigger(processingTime="0 seconds").start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    late, left = 0, 0
    try:
        for source in [*(f"staged/{_SLICE}={n}" for n in numbers), *_ENDS]:
            incoming.take(f"{folder}/{source}", f"slice-{source.rpartition('/')[2].rpartition('=')[2]}")
            query.processAllAvailable()
        for p in query.recentProgress:
            late += sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])
        left = sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"])
    finally:
        query.stop()
    if late or left > len(_ENDS) * rows.count():
        raise RuntimeError(f"{late} rows came too late and {left} states are left")
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
