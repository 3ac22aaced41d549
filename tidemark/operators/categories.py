"""Aggregates by category of whole groups, in two levels of grouping."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.aggregates import encode, top_keys, top_values, value_kind
from tidemark.operators.frames import wrapped

if TYPE_CHECKING:
    from tidemark.operators.features import Feature

_NAME = re.compile(r"^(?:(count|sum|avg|min|max)_cate(_where)?|top_n_(key|value)_(count|sum|avg|min|max)_cate_where|top_n_(key|value)_ratio_cate)$")


def is_category(name: str) -> bool:
    return bool(_NAME.match(name))


def _place(feature: Feature) -> int:
    """Which argument is the category."""
    return 1 if re.fullmatch(r"\w+_cate", feature.name) and "ratio" not in feature.name else 2


def by_category(features: Sequence[Feature]) -> list[list[Feature]]:
    """Features that share their category column, so that one grouping serves them."""
    out: dict[str, list[Feature]] = {}
    for f in features:
        c = f.args[_place(f)]
        out.setdefault(c if isinstance(c, str) else c._jc.toString(), []).append(f)
    return list(out.values())


def category_features(df: DataFrame, keys: Sequence[str], features: Sequence[Feature]) -> DataFrame:
    """``__key`` columns and the encoded features, all over the same category column.

    First one row per key and category, combined before the shuffle; then the categories of a key are put
    together, which is as many entries as it has categories, not rows.
    """
    col = lambda a: F.col(a) if isinstance(a, str) else a
    kind_of = lambda c: df.select(c.alias("x")).schema["x"].dataType.simpleString()
    category = col(features[0].args[_place(features[0])])
    values, outputs = [], []
    for n, feature in enumerate(features):
        m = _NAME.match(feature.name)
        how = m.group(1) or m.group(4) or "ratio"
        x = col(feature.args[0])
        cond = F.coalesce(col(feature.args[1]), F.lit(False)) if _place(feature) == 2 else F.lit(True)
        kind = kind_of(x)
        use = x.isNotNull() if how == "ratio" else x.isNotNull() & cond
        number = F.when(use, x.cast("double" if how == "avg" or kind in ("float", "double") else "bigint")) if how in ("sum", "avg") else None
        value: Column = {
            "count": lambda use=use: F.nullif(F.count_if(use), F.lit(0)),
            "sum": lambda number=number, kind=kind: wrapped(F.sum(number), kind),
            "avg": lambda number=number: F.avg(number),
            "min": lambda use=use, x=x: F.min(F.when(use, x)),
            "max": lambda use=use, x=x: F.max(F.when(use, x)),
            "ratio": lambda use=use, cond=cond: F.avg(F.when(use, cond.cast("double"))),
        }[how]()
        values.append(value.alias(f"__v{n}"))
        pairs = F.array_sort(F.collect_list(F.when(F.col(f"__v{n}").isNotNull(), F.struct(F.col("__c").alias("k"), F.col(f"__v{n}").alias("v")))))
        outputs.append((feature, pairs.alias(f"__p{n}"), m.group(3) or m.group(5), "double" if how == "ratio" else value_kind(how, kind)))
    each = df.filter(category.isNotNull()).groupBy(*[F.col(k).alias(f"__{k}") for k in keys], category.alias("__c")).agg(*values)
    found = each.groupBy(*[f"__{k}" for k in keys]).agg(*[p for _, p, _, _ in outputs])
    key_kind = kind_of(category)

    def text(n: int, feature: Feature, top: str | None, kind: str) -> Column:
        best = F.col(f"__p{n}")
        if top:
            best = (top_keys if top == "key" else top_values)(best, feature.args[3])
        return encode(best, key_kind, kind).alias(feature.alias)

    return found.select(*[f"__{k}" for k in keys], *[text(n, f, top, kind) for n, (f, _, top, kind) in enumerate(outputs)])
