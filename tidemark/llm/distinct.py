"""Distinct counts over huge identifier sets by linear counting on mergeable bitmaps.

A group's bitmap has ``bits`` bits and is kept as rows (group, word, bits of the word), empty words left out.
So no bitmap is ever one value in one task; partial results of any split of the data are merged by bitwise
union, and a coarser group's bitmap is the union of those of its parts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = 64


def relative_error(n: float, bits: int) -> float:
    """Standard error of the estimate of n distinct values on ``bits`` bits, as a share of n."""
    t = n / bits
    return math.sqrt(bits * (math.exp(t) - t - 1)) / n


def bitmap_bits(capacity: int, error: float) -> int:
    """The least number of bits (a multiple of 64) that estimates any count up to ``capacity`` within ``error``.

    Standard error as a share of the count; besides, at capacity at least five standard deviations of
    empty bits are left, so that a full bitmap is out of the question.
    """
    if not 0 < error < 1:
        raise ValueError("error must be between 0 and 1")
    capacity = max(capacity, 1)

    def enough(bits: int) -> bool:
        t = capacity / bits
        return t < 50 and relative_error(capacity, bits) <= error and 1 / math.sqrt(2 * bits) <= error and bits * math.exp(-t) >= 25

    low, high = 1, 1
    while not enough(high * WORD):
        high *= 2
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if enough(mid * WORD) else (mid + 1, high)
    return low * WORD


def bitmap_partials(events: DataFrame, groups: Sequence[str], item: str, bits: int) -> DataFrame:
    """Words of each group's bitmap: columns ``groups``, ``word``, ``bits``.

    A NULL item sets no bit, yet its group appears; a NULL group value is a group of its own. The union is
    taken before the shuffle, so a group that holds much of the table sends at most bits/64 rows per task.
    """
    at = F.pmod(F.xxhash64(item), F.lit(bits))
    known = F.col(item).isNotNull()
    word = F.when(known, F.floor(at / WORD)).otherwise(0).cast("int")
    events = events.select(*groups, word.alias("word"), F.when(known, F.pmod(at, F.lit(WORD)).cast("int")).alias("__bit"))
    return events.groupBy(*groups, "word").agg(F.bit_or(F.expr("CASE WHEN __bit IS NULL THEN 0L ELSE shiftleft(1L, __bit) END")).alias("bits"))


def bitmaps(events: DataFrame, groups: Sequence[str], item: str, capacity: int, error: float = 0.01) -> DataFrame:
    """``bitmap_partials`` with their ``size`` in bits, which depends on the parameters only: partials of any data with the same ones merge."""
    bits = bitmap_bits(capacity, error)
    return bitmap_partials(events, groups, item, bits).withColumn("size", F.lit(bits))


def merge_partials(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The union of partial bitmaps over the same groups; partials of different sizes, where they say it, are an error."""
    whole = first
    if "size" in first.columns:
        whole = whole.unionByName(others[0]) if others else whole
        for x in others[1:]:
            whole = whole.unionByName(x)
        size = F.when(F.min("size") == F.max("size"), F.max("size")).otherwise(F.raise_error(F.lit("bitmaps of different sizes don't merge")))
        return whole.groupBy(*[c for c in first.columns if c not in ("bits", "size")]).agg(F.bit_or("bits").alias("bits"), size.alias("size"))
    for x in others:
        whole = whole.unionByName(x)
    return whole.groupBy(*[c for c in first.columns if c != "bits"]).agg(F.bit_or("bits").alias("bits"))


def roll_up(partials: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Bitmap words of every combination of ``groups``, out of those of all of them together.

    ``level`` names the columns a row is grouped by ("" for none); the others are NULL in it. Each combination is the union over one that has
    one column more, so words that are merged already aren't merged again from the finest ones.
    """
    levels: dict[tuple, DataFrame] = {tuple(groups): partials.select(*groups, "word", "bits")}
    for size in range(len(groups) - 1, -1, -1):
        for kept in combinations(groups, size):
            parent = next(levels[p] for p in combinations(groups, size + 1) if set(kept) < set(p))
            levels[kept] = parent.groupBy(*kept, "word").agg(F.bit_or("bits").alias("bits"))
    out = None
    for kept, part in levels.items():
        part = part.select(F.lit(",".join(kept)).alias("level"), *[F.col(g) if g in kept else F.lit(None).cast(partials.schema[g].dataType).alias(g) for g in groups], "word", "bits")
        out = part if out is None else out.unionByName(part)
    return out


def estimates(words: DataFrame, by: Sequence[str], bits: int) -> DataFrame:
    """Columns ``by``, ``estimate``, its standard error as a share ``std_error``, and ``saturated``.

    With v the share of empty bits the estimate is -bits ln v. A full bitmap has no estimate: NULL, and
    ``saturated`` is true. A group whose items are all NULL has estimate 0.
    """
    ones = words.groupBy(*by).agg(F.sum(F.bit_count("bits")).alias("__ones"))
    n = -F.lit(float(bits)) * F.log(1 - F.col("__ones") / F.lit(float(bits)))
    t = F.col("estimate") / F.lit(float(bits))
    error = F.when(F.col("estimate") > 0, F.sqrt(F.lit(float(bits)) * F.greatest(F.exp(t) - t - 1, F.lit(0.0))) / F.col("estimate")).when(F.col("estimate") == 0, 0.0)
    full = F.col("__ones") >= bits
    return ones.withColumn("estimate", F.when(~full, F.when(F.col("__ones") == 0, 0.0).otherwise(n))).select(*by, "estimate", error.alias("std_error"), full.alias("saturated"))


def distinct_counts(events: DataFrame, groups: Sequence[str], item: str, capacity: int, error: float = 0.01) -> DataFrame:
    """Estimated distinct ``item`` for every combination of ``groups``, with the error stated per row."""
    bits = bitmap_bits(capacity, error)
    words = roll_up(bitmap_partials(events, groups, item, bits), groups)
    return estimates(words, ["level", *groups], bits).withColumn("bits", F.lit(bits))
