"""Functions and aggregates that a user keeps in a Python file."""

from __future__ import annotations

import runpy
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _of(path: str, *names: str, optional: Sequence[str] = ()) -> list:
    found = runpy.run_path(path)
    missing = [n for n in names if not callable(found.get(n)) and n not in optional]
    if missing:
        raise ValueError(f"{path} has no functions {missing}")
    return [found.get(n) for n in names]


def function(path: str, name: str, kinds: Sequence[str], kind: str) -> Callable[..., Column]:
    """A function over series, run on Arrow batches; the file is read once, on the driver."""
    (f,) = _of(path, name)

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        return f(*columns)

    return lambda *args: run(*[(a if isinstance(a, Column) else F.lit(a)).cast(k) for a, k in zip(args, kinds)])


def aggregate(path: str, name: str, kinds: Sequence[str], kind: str) -> Callable[..., Column]:
    """An aggregate of the known values of a frame or group, oldest first, run on Arrow batches of their lists.

    With a merge, long lists are folded in runs that are merged, so that a state needs only be right for a run and a merge.
    """
    init, update, merge, output = _of(path, f"{name}_init", f"{name}_update", f"{name}_merge", f"{name}_output", optional=(f"{name}_merge",))
    run_length = 4096

    def fold(values: Iterator) -> object:
        state = init()
        for v in values:
            state = update(state, v)
        return state

    def result(values) -> object:
        if values is None or len(values) == 0:
            return output(init())
        if merge is None:
            return output(fold(values))
        state = fold(values[:run_length])
        for a in range(run_length, len(values), run_length):
            state = merge(state, fold(values[a : a + run_length]))
        return output(state)

    @F.pandas_udf(kind)
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(result, na_action=None)

    return lambda s, x: run(s.list(x.cast(kinds[0])))
