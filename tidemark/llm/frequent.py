"""The most frequent items of columns with billions of rows, in bounded memory.

A count-sketch with signed hashes for each of four prefix lengths of a 32-bit hash of the value. Each task
fills its own sketch (a fixed number of counters), the sketches are added up, and the driver descends from
the heavy one-byte prefixes to the heavy full hashes. A second scan counts the values with such a hash, so
that what is given out is exact and hash collisions do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.workers import equip

LEVELS, DEPTH, WIDTH = 4, 7, 8192
_FLUSH = 1 << 17
_SKETCH = "field int, level int, row int, part int, counters binary"
#: Sketches of tasks are added up in so many parts first, and then all parts.
PARTS = 32


def _cells(prefix: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Counter and sign of each prefix in one row of one level's sketch."""
    with np.errstate(over="ignore"):
        z = (prefix.astype(np.uint64) + np.uint64(1 + row * LEVELS + level) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(31)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(29)
    return (z & np.uint64(WIDTH - 1)).astype(np.int64), ((z >> np.uint64(40)) & np.uint64(1)).astype(np.int64) * 2 - 1


def _prefix(hashes: np.ndarray, level: int) -> np.ndarray:
    return hashes >> np.int64(8 * (LEVELS - 1 - level))


def _fill(fields: int):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((fields, LEVELS, DEPTH, WIDTH), np.int64)
        kept: list[list[np.ndarray]] = [[] for _ in range(fields)]
        rows = 0

        def flush(f: int) -> None:
            if kept[f]:
                values, counts = np.unique(np.concatenate(kept[f]), return_counts=True)
                kept[f] = []
                for level in range(LEVELS):
                    prefix = _prefix(values, level)
                    for row in range(DEPTH):
                        at, sign = _cells(prefix, level, row)
                        sketch[f, level, row] += np.bincount(at, weights=sign * counts, minlength=WIDTH).astype(np.int64)

        for batch in batches:
            rows += batch.num_rows
            for f in range(fields):
                kept[f].append(batch.column(f).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
                if sum(map(len, kept[f])) >= _FLUSH:
                    flush(f)
        for f in range(fields):
            flush(f)
        if rows:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId() % PARTS
            keys = [(f, level, row) for f in range(fields) for level in range(LEVELS) for row in range(DEPTH)]
            yield _rows([(-1, 0, 0, part, np.array([rows], np.int64))] + [(*k, part, sketch[k]) for k in keys])

    return fill


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32()) for i in range(4)] + [pa.array([r[4].tobytes() for r in rows], pa.binary())], names=["field", "level", "row", "part", "counters"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up sketches as they stream by; holds one row of counters per field, level, row and part that comes."""
    total: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for *key, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
            part = np.frombuffer(raw, np.int64)
            if tuple(key) in total:
                total[tuple(key)] += part
            else:
                total[tuple(key)] = part.copy()
    if total:
        yield _rows([(*k, v) for k, v in total.items()])


def sketch(df: DataFrame, fields: list[str]) -> tuple[int, np.ndarray]:
    """Number of rows, and the counters by field, level, row and cell; NULL values are not counted.

    What reaches the driver has a fixed size: 4 * 7 * 8192 counters for each field.
    """
    equip(df.sparkSession)
    hashed = df.select(*[F.when(F.col(c).isNotNull(), F.shiftrightunsigned(F.xxhash64(c), 32)).alias(c) for c in fields])
    parts = hashed.mapInArrow(_fill(len(fields)), _SKETCH)
    by = ["field", "level", "row"]
    some = parts.repartition(*by, "part").mapInArrow(_add, _SKETCH).withColumn("part", F.lit(0))
    merged = some.repartition(LEVELS * len(fields), *by).mapInArrow(_add, _SKETCH)
    rows, counters = 0, np.zeros((len(fields), LEVELS, DEPTH, WIDTH), np.int64)
    for r in merged.collect():
        if r.field < 0:
            rows += int(np.frombuffer(r.counters, np.int64)[0])
        else:
            counters[r.field, r.level, r.row] += np.frombuffer(r.counters, np.int64)
    return rows, counters


def estimate(counters: np.ndarray, prefixes: np.ndarray, level: int) -> np.ndarray:
    """Estimated counts of prefixes: the median over the rows of a field's sketch at a level."""
    found = np.empty((DEPTH, len(prefixes)), np.int64)
    for row in range(DEPTH):
        at, sign = _cells(prefixes, level, row)
        found[row] = counters[level, row, at] * sign
    return np.median(found, axis=0)


def descend(counters: np.ndarray, least: float) -> dict[int, int]:
    """Full hashes whose estimate and all of whose prefixes' estimates reach ``least``."""
    heavy, counts = np.zeros(1, np.int64), np.zeros(1)
    for level in range(LEVELS):
        below = (heavy[:, None] * 256 + np.arange(256)).ravel() if level else np.arange(256)
        counts = estimate(counters, below, level)
        heavy, counts = below[counts >= least], counts[counts >= least]
    return dict(zip(heavy.tolist(), counts.astype(int).tolist()))


def frequent_items(df: DataFrame, fields: list[str], share: float) -> DataFrame:
    """Values that at least ``share`` of all rows have: ``field_name``, ``field_value`` (string), ``approx_count``, ``count``.

    The base is every row, also those with a NULL. The descent keeps what reaches half of the share: the
    sketch's error is about 1/90 of the root of the sum of squared shares of the rest, so to lose a value at the
    share takes an error of half of it in four of seven rows at once. ``count`` is exact, from the second
    scan. Ties are all given; an empty table gives no row.
    """
    rows, counters = sketch(df, fields)
    spark = df.sparkSession
    candidates = [descend(counters[f], max(1.0, share / 2 * rows)) for f in range(len(fields))]
    found = None
    for c, hashes in zip(fields, candidates):
        hashed = F.shiftrightunsigned(F.xxhash64(c), 32)
        near = F.create_map(*[F.lit(x).cast("long") for kv in hashes.items() for x in kv]) if hashes else F.lit(None)
        part = df.filter(F.col(c).isNotNull() & (hashed.isin(list(hashes)) if hashes else F.lit(False)))
        part = part.groupBy(F.col(c).alias("__v")).agg(F.count(F.lit(1)).alias("count")).select(F.lit(c).alias("field_name"), F.col("__v").cast("string").alias("field_value"), (near[F.shiftrightunsigned(F.xxhash64("__v"), 32)] if hashes else near).cast("long").alias("approx_count"), "count")
        found = part if found is None else found.unionByName(part)
    return found.filter(F.col("count") >= F.lit(share * rows))
