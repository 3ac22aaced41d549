"""Feature queries: windows and joins on a table, in batch and for request rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.aggregates import REGISTRY
from tidemark.operators.frames import Frame, Scope, finish, prepare, shared
from tidemark.timeutil import floor_div, millis


class Feature:
    """An aggregate by name with its arguments: columns, or literals where the aggregate takes some.

    A string that is the name of a column of the table stands for the column.
    """

    def __init__(self, name: str, *args, alias: str):
        self.name, self.args, self.alias = name.lower(), args, alias
        if self.name not in REGISTRY:
            raise ValueError(f"no such aggregate: {name}")

    def column(self, scope: Scope) -> Column:
        return REGISTRY[self.name](scope, *[F.col(a) if isinstance(a, str) and a in scope.df.columns else a for a in self.args]).alias(self.alias)


def window_features(df: DataFrame, frames: Sequence[tuple[Frame, Sequence[Feature]]], keep: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``df`` with features over several frames.

    Frames over the same partition, order and union tables share one preparation of their rows, so they cost one
    shuffle, and one sort for each order; others add a pass each. Rows without a valid time are left out, as every frame needs one.
    """
    keep = list(keep or df.columns)
    groups: dict[tuple, list[tuple[Frame, Sequence[Feature]]]] = {}
    for frame, features in frames:
        groups.setdefault(shared(frame), []).append((frame, features))
    out, done = df, []
    for together in groups.values():
        unions = [_padded(u, df, out) for u in together[0][0].unions]
        rows = prepare(out, *[replace(frame, unions=unions) for frame, _ in together])
        for frame, features in together:
            scope = Scope(rows, frame)
            columns = {f.alias: f.column(scope) for f in features}
            rows = scope.df.withColumns(columns)
            done += list(columns)
        out = finish(rows)
    return out.select(*keep, *[d for d in done if d not in keep])


def _padded(union: DataFrame, first: DataFrame, now: DataFrame) -> DataFrame:
    """A union table with the columns that earlier frames have added, as NULL."""
    if len(union.columns) != len(first.columns):
        raise ValueError("a table of a window union has other columns than the first")
    out = union.toDF(*first.columns)
    return out.select(*first.columns, *[F.lit(None).cast(now.schema[c].dataType).alias(c) for c in now.columns if c not in first.columns])


def relevant_history(requests: DataFrame, history: DataFrame, frame: Frame) -> DataFrame:
    """The rows of ``history`` that windows of the requests can reach: of their keys, and of a range frame's spans of time.

    A NULL key is a key like any other, as it is in windows.
    """
    keys = list(frame.partition_by)
    asked = requests.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)])
    rows, same = history, F.lit(True)
    if frame.order_by and frame.kind == "rows_range" and frame.start:
        at = millis(requests, frame.order_by)
        spans = F.array_distinct(F.array(floor_div(at - frame.start, frame.start), floor_div(at, frame.start)))
        asked = requests.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)], F.explode(spans).alias("__asked"))
        rows = history.withColumn("__span", floor_div(millis(history, frame.order_by), frame.start))
        same = F.col("__span") == F.col("__asked")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__r{i}"))
    return rows.join(asked.distinct(), same, "left_semi").select(*history.columns)


def request_features(requests: DataFrame, history: DataFrame, frames: Sequence[tuple[Frame, Sequence[Feature]]], keep: Sequence[str] | None = None) -> DataFrame:
    """Features of request rows, each as if it alone were inserted into ``history``.

    The history is the union table and the requests see nothing of each other, so a batch of requests of any
    size gives each the answer it would get alone. Only what their windows can reach is read into the windows, and range
    frames are split into spans of time, so that a hot key's history doesn't meet in one task.
    """
    served = [(request_frame(requests, history, frame), features) for frame, features in frames]
    return window_features(requests, served, keep)


def request_frame(requests: DataFrame, history: DataFrame, frame: Frame) -> Frame:
    """The frame for request rows over their history."""
    past = relevant_history(requests, history, frame)
    split = frame.start if frame.order_by and frame.kind == "rows_range" and frame.start else None
    return replace(frame, unions=[past, *frame.unions], instance_not_in_window=True, block_ms=frame.block_ms or split)


def group_features(df: DataFrame, keys: Sequence[str], features: Sequence[Feature], order: Sequence[str] = (), having: Column | None = None) -> DataFrame:
    """Aggregates per group.

    Aggregates by category, and those that need how often each value occurs, are computed per category or value
    first, so no group is collected whole; those over the same column share one grouping. Only the aggregates whose
    result depends on the order of a group's rows (``ew_avg``, ``drawdown``, ``nth_value_where``, the splits) collect
    it, oldest first by ``order``: for large groups use them over windows.
    """
    from tidemark.operators.categories import by_category, category_features, is_category
    from tidemark.operators.tallies import by_value, empty, is_tally, tally_features

    plain = [f for f in features if not is_category(f.name) and not is_tally(f.name)]
    scope = Scope(df, order=order)
    out = df.groupBy(*keys).agg(*[f.column(scope) for f in plain] or [F.count(F.lit(1)).alias("__rows")])

    def joined(whole: DataFrame, part: DataFrame, missing: dict[str, Column]) -> DataFrame:
        cond = F.lit(True)
        for n, k in enumerate(keys):
            same = whole[k].eqNullSafe(part[f"__{k}"])
            cond = same if n == 0 else cond & same
        return whole.join(part, cond, "left").drop(*[f"__{k}" for k in keys]).withColumns({a: F.coalesce(F.col(a), c) for a, c in missing.items()})

    for shared in by_category([f for f in features if is_category(f.name)]):
        out = joined(out, category_features(df, keys, shared), {f.alias: F.lit("") for f in shared})
    for shared in by_value([f for f in features if is_tally(f.name)]):
        for part in tally_features(df, keys, shared):
            out = joined(out, part, {f.alias: empty(f) for f in shared if f.alias in part.columns})
    out = out.select(*keys, *[f.alias for f in features])
    return out if having is None else out.filter(having)
