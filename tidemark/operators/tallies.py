"""Aggregates of whole groups that need how often each value occurs, in two levels of grouping."""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import fixed

if TYPE_CHECKING:
    from tidemark.operators.features import Feature

#: Name -> what a group without a known value has (None: NULL, "fill": as many "NULL" as asked for).
NAMES = {"entropy": None, "top1_ratio": 0.0, "top": "", "topn_frequency": "fill"}


def is_tally(name: str) -> bool:
    return name in NAMES


def by_value(features: Sequence[Feature]) -> list[list[Feature]]:
    """Features over the same column, so that one grouping serves them."""
    out: dict[str, list[Feature]] = {}
    for f in features:
        x = f.args[0]
        out.setdefault(x if isinstance(x, str) else x._jc.toString(), []).append(f)
    return list(out.values())


def empty(feature: Feature) -> Column:
    none = NAMES[feature.name]
    return F.lit(",".join(["NULL"] * int(feature.args[1])) if none == "fill" else none)


def tally_features(df: DataFrame, keys: Sequence[str], features: Sequence[Feature]) -> list[DataFrame]:
    """Tables of ``__key`` columns and features, all over the same column; groups without a known value are missing.

    One row per key and value, combined before the shuffle. Entropy and the share of the commonest value are sums
    over those; the top values are cut to as many as asked for before they are put together.
    """
    x = features[0].args[0]
    x = F.col(x) if isinstance(x, str) else x
    kind = df.select(x.alias("x")).schema["x"].dataType.simpleString()
    own = [f"__{k}" for k in keys]
    tally = df.filter(x.isNotNull()).groupBy(*[F.col(k).alias(f"__{k}") for k in keys], x.alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    n, total = F.col("__n").cast("double"), F.sum(F.col("__n").cast("double"))
    sums = {"entropy": F.log2(total) - F.sum(n * F.log2(n)) / total, "top1_ratio": F.max(n) / total}
    out = []
    if summed := [f for f in features if f.name in sums]:
        out.append(tally.groupBy(*own).agg(*[sums[f.name].alias(f.alias) for f in summed]))
    for f in features:
        if f.name in sums:
            continue
        most = int(f.args[1])
        order = [F.col("__x").desc()] if f.name == "top" else [F.col("__n").desc(), F.col("__x")]
        cut = tally.withColumn("__k", F.row_number().over(Window.partitionBy(*own or [F.lit(0)]).orderBy(*order))).filter(F.col("__k") <= most)
        text = fixed(F.col("__x"), kind)
        each = F.array_repeat(text, F.least(F.col("__n"), F.lit(most)).cast("int")) if f.name == "top" else F.array(text)
        parts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__k").alias("k"), each.alias("v")))), lambda e: e["v"]))
        parts = F.slice(parts, 1, most)
        if f.name == "topn_frequency":
            parts = F.concat(parts, F.array_repeat(F.lit("NULL"), F.lit(most) - F.size(parts)))
        out.append(cut.groupBy(*own).agg(F.array_join(parts, ",").alias(f.alias)))
    return out
