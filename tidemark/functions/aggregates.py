"""Aggregates of the dialect. Each takes a ``Scope`` (a frame, or a group) and columns.

NULL values are skipped unless said otherwise; nothing known gives NULL, of counts 0, of encoded strings "".
Encoded strings write floating numbers with six decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalar import fixed
from tidemark.operators.frames import Scope, wrapped

REGISTRY: dict[str, Callable[..., Column]] = {}


def aggregate(*names: str):
    def add(f):
        for n in names:
            REGISTRY[n] = f
        return f

    return add


@aggregate("count")
def count(s: Scope, x: Column) -> Column:
    return s.count(x)


@aggregate("sum")
def sum_(s: Scope, x: Column) -> Column:
    return s.sum(x)


@aggregate("avg")
def avg(s: Scope, x: Column) -> Column:
    return s.avg(x)


@aggregate("min")
def min_(s: Scope, x: Column) -> Column:
    return s.min(x)


@aggregate("max")
def max_(s: Scope, x: Column) -> Column:
    return s.max(x)


#: What NULL counts as in ``distinct_count``.
DEFAULTS = {"string": "", "boolean": False, "date": "1900-01-01", "timestamp": "1970-01-01 00:00:00", "timestamp_ntz": "1970-01-01 00:00:00"}


@aggregate("distinct_count")
def distinct_count(s: Scope, x: Column, compat: bool = True) -> Column:
    """Different values; NULL counts as the type's default value, with ``compat`` off not at all."""
    if compat:
        kind = s.type_of(x)
        x = F.coalesce(x, F.lit(DEFAULTS.get(kind, 0)).cast(kind))
    if s.native:
        return F.size(s.native(F.collect_set(x))).cast("long") if s.frame else F.count_distinct(x)
    return F.size(F.array_distinct(s.list(x))).cast("long")


@aggregate("median")
def median(s: Scope, x: Column) -> Column:
    if s.frame is None:
        return F.median(x.cast("double"))
    xs = F.array_sort(s.list(x.cast("double")))
    n = F.size(xs)
    at = lambda i: F.try_element_at(xs, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)


@aggregate("var_samp", "variance")
def var_samp(s: Scope, x: Column) -> Column:
    return s.variance(x, True)


@aggregate("var_pop")
def var_pop(s: Scope, x: Column) -> Column:
    return s.variance(x, False)


@aggregate("stddev", "std", "stddev_samp")
def stddev(s: Scope, x: Column) -> Column:
    return F.sqrt(s.variance(x, True))


@aggregate("stddev_pop")
def stddev_pop(s: Scope, x: Column) -> Column:
    return F.sqrt(s.variance(x, False))


def _runs(ordered: Column, key: Callable[[Column], Column], first: Callable[[Column], Column], further: Callable[[Column, Column], Column], value: Callable[[Column], Column], kinds: tuple[str, str, str]) -> Column:
    """Array of (k, v), one for each run of equal keys of an ordered array, in one walk along it.

    ``first`` gives the state of a run from its first element, ``further`` from the state so far and the next, ``value`` its value from (k, v, n); ``kinds`` are
    the types of keys, states and values.
    """
    key_kind, state_kind, value_kind = kinds
    pair = lambda a: F.struct(a["k"].cast(key_kind).alias("k"), value(a).cast(value_kind).alias("v"))
    zero = F.struct(F.array().cast(f"array<struct<k:{key_kind},v:{value_kind}>>").alias("out"), F.lit(None).cast(key_kind).alias("k"), F.lit(None).cast(state_kind).alias("v"), F.lit(0).cast("bigint").alias("n"))

    def step(a: Column, e: Column) -> Column:
        same = (a["n"] > 0) & (a["k"] == key(e))
        out = F.when(same | (a["n"] == 0), a["out"]).otherwise(F.concat(a["out"], F.array(pair(a))))
        state = F.when(same, further(a, e)).otherwise(first(e)).cast(state_kind)
        return F.struct(out.alias("out"), key(e).cast(key_kind).alias("k"), state.alias("v"), F.when(same, a["n"] + 1).otherwise(F.lit(1)).cast("bigint").alias("n"))

    return F.aggregate(ordered, zero, step, lambda a: F.when(a["n"] > 0, F.concat(a["out"], F.array(pair(a)))).otherwise(a["out"]))


def _tally(s: Scope, xs: Column, kind: str) -> Column:
    """Array of (value, count), values ascending."""
    if _short(s):
        return F.transform(F.array_sort(F.array_distinct(xs)), lambda k: F.struct(k.alias("k"), F.size(F.filter(xs, lambda x: x == k)).cast("long").alias("n")))
    runs = _runs(F.array_sort(xs), lambda e: e, lambda e: F.lit(0), lambda a, e: F.lit(0), lambda a: a["n"], (kind, "int", "bigint"))
    return F.transform(runs, lambda e: F.struct(e["k"].alias("k"), e["v"].alias("n")))


@aggregate("entropy")
def entropy(s: Scope, x: Column) -> Column:
    """Of the values' shares, in bits."""
    xs = s.list(x)
    total = F.size(xs).cast("double")
    return F.when(total > 0, F.aggregate(_tally(s, xs, s.type_of(x)), F.lit(0.0), lambda a, e: a - e["n"] / total * F.log2(e["n"] / total)))


@aggregate("ew_avg")
def ew_avg(s: Scope, x: Column, alpha) -> Column:
    """Weights fall by (1 - alpha) from the newest to the oldest known value; alpha NULL or 0 gives the average."""
    alpha = F.coalesce(alpha if isinstance(alpha, Column) else F.lit(alpha), F.lit(0.0)).cast("double")
    xs = F.reverse(s.list(x.cast("double")))
    weights = F.aggregate(xs, F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("low"), F.lit(1.0).alias("w")), lambda a, v: F.struct((a["top"] + a["w"] * v).alias("top"), (a["low"] + a["w"]).alias("low"), (a["w"] * (1 - alpha)).alias("w")))
    return F.when(F.size(xs) > 0, weights["top"] / weights["low"])


@aggregate("drawdown")
def drawdown(s: Scope, x: Column) -> Column:
    """The largest fall from a peak to a later valley, as a share of the peak; values below zero are ignored."""
    xs = F.filter(s.list(x.cast("double")), lambda v: v >= 0)
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("fall"))
    walk = F.aggregate(xs, start, lambda a, v: F.struct(F.greatest(a["peak"], v).alias("peak"), F.greatest(a["fall"], F.when(F.greatest(a["peak"], v) > 0, (F.greatest(a["peak"], v) - v) / F.greatest(a["peak"], v)).otherwise(0.0)).alias("fall")))
    return F.when(F.size(xs) > 0, walk["fall"])


def _joined(s: Scope, xs: Column, kind: str) -> Column:
    return F.array_join(F.transform(xs, lambda v: fixed(v, kind)), ",")


@aggregate("top")
def top(s: Scope, x: Column, k) -> Column:
    """The k largest values, repeats included, comma separated."""
    return _joined(s, F.slice(F.sort_array(s.list(x), asc=False), F.lit(1), _int(k)), s.type_of(x))


def _int(n) -> Column:
    return n.cast("int") if isinstance(n, Column) else F.lit(int(n))


@aggregate("topn_frequency")
def topn_frequency(s: Scope, x: Column, n) -> Column:
    """The n most frequent values, smaller first among equals, filled up with "NULL"."""
    kind = s.type_of(x)
    tally = F.transform(_tally(s, s.list(x), kind), lambda e: F.struct((-e["n"]).alias("n"), e["k"].alias("k")))
    best = F.transform(F.slice(F.array_sort(tally), F.lit(1), _int(n)), lambda e: fixed(e["k"], kind))
    return F.array_join(F.concat(best, F.array_repeat(F.lit("NULL"), _int(n) - F.size(best))), ",")


@aggregate("top1_ratio")
def top1_ratio(s: Scope, x: Column) -> Column:
    xs = s.list(x)
    return F.when(F.size(xs) > 0, F.array_max(F.transform(_tally(s, xs, s.type_of(x)), lambda e: e["n"])) / F.size(xs)).otherwise(0.0)


for _n in ("count", "sum", "avg", "min", "max"):
    REGISTRY[f"{_n}_where"] = (lambda f: lambda s, x, cond: f(s, F.when(cond, x)))(REGISTRY[_n])


@aggregate("nth_value_where")
def nth_value_where(s: Scope, x: Column, n, cond: Column) -> Column:
    """The n-th row's value with a true condition, counted from the oldest row (n < 0: from the newest); 0 gives NULL."""
    hits = F.filter(s.rows(F.struct(x.alias("x"), F.coalesce(cond, F.lit(False)).alias("c"))), lambda e: e["c"])
    n = _int(n)
    return F.when(n != 0, F.try_element_at(hits, F.nullif(n, F.lit(0)))["x"])


# ---- by category


def _short(s: Scope) -> bool:
    """Whether a frame has few rows by its bounds, so that looking through them for each category costs less than a walk that keeps state."""
    f = s.frame
    most = None if f is None else f.maxsize if f.maxsize is not None else f.start + 1 if f.kind == "rows" and f.start is not None else None
    return most is not None and most <= 32


def _by_key(how: str, rows: Column, kind: str, wide: str) -> Column:
    def value(k: Column) -> Column:
        xs = F.transform(F.filter(rows, lambda e: e["k"] == k), lambda e: e["x"])
        if how == "count":
            return F.size(xs).cast("long")
        if how in ("min", "max"):
            return (F.array_min if how == "min" else F.array_max)(xs)
        total = F.aggregate(xs, F.lit(0).cast(wide), lambda a, v: a + v.cast(wide))
        return total / F.size(xs) if how == "avg" else wrapped(total, kind)

    keys = F.array_sort(F.array_distinct(F.transform(rows, lambda e: e["k"])))
    return F.transform(keys, lambda k: F.struct(k.alias("k"), value(k).alias("v")))


def by_category(s: Scope, how: str, x: Column, category: Column, cond: Column | None = None) -> Column:
    """Array of (key, value) of a frame's categories, keys ascending; a NULL key or value is skipped."""
    use = x.isNotNull() & category.isNotNull() & (F.coalesce(cond, F.lit(False)) if cond is not None else F.lit(True))
    kind = s.type_of(x)
    wide = "double" if how == "avg" or kind in ("float", "double") else "bigint"
    rows = s.list(F.when(use, F.struct(category.alias("k"), x.alias("x"))))
    if _short(s):
        return _by_key(how, rows, kind, wide)
    rows = F.array_sort(rows)
    state = {"sum": wide, "avg": wide, "count": "int"}.get(how, kind)
    number = lambda e: F.lit(0) if how == "count" else e["x"].cast(state)
    # in order of key and value: the first of a run is its least, the last its greatest
    further = {"sum": lambda a, e: a["v"] + number(e), "avg": lambda a, e: a["v"] + number(e), "max": lambda a, e: number(e)}.get(how, lambda a, e: a["v"])
    value = {"count": lambda a: a["n"], "avg": lambda a: a["v"] / a["n"], "sum": lambda a: wrapped(a["v"], kind)}.get(how, lambda a: a["v"])
    return _runs(rows, lambda e: e["k"], number, further, value, (s.type_of(category), state, value_kind(how, kind)))


def encode(pairs: Column, key_kind: str, value_kind: str) -> Column:
    """``k1:v1,k2:v2``."""
    return F.array_join(F.transform(pairs, lambda e: F.concat(fixed(e["k"], key_kind), F.lit(":"), fixed(e["v"], value_kind))), ",")


def top_keys(pairs: Column, n) -> Column:
    return F.slice(F.reverse(pairs), F.lit(1), _int(n))


def top_values(pairs: Column, n) -> Column:
    """Largest values first, among equals the larger key first."""
    order = F.sort_array(F.transform(pairs, lambda e: F.struct(e["v"].alias("v"), e["k"].alias("k"))), asc=False)
    return F.transform(F.slice(order, F.lit(1), _int(n)), lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v")))


def value_kind(how: str, kind: str) -> str:
    return {"count": "bigint", "avg": "double"}.get(how, kind)


def _category(how: str):
    def plain(s: Scope, x: Column, category: Column) -> Column:
        return encode(by_category(s, how, x, category), s.type_of(category), value_kind(how, s.type_of(x)))

    def where(s: Scope, x: Column, cond: Column, category: Column) -> Column:
        return encode(by_category(s, how, x, category, cond), s.type_of(category), value_kind(how, s.type_of(x)))

    def key(s: Scope, x: Column, cond: Column, category: Column, n) -> Column:
        return encode(top_keys(by_category(s, how, x, category, cond), n), s.type_of(category), value_kind(how, s.type_of(x)))

    def value(s: Scope, x: Column, cond: Column, category: Column, n) -> Column:
        return encode(top_values(by_category(s, how, x, category, cond), n), s.type_of(category), value_kind(how, s.type_of(x)))

    REGISTRY[f"{how}_cate"], REGISTRY[f"{how}_cate_where"] = plain, where
    REGISTRY[f"top_n_key_{how}_cate_where"], REGISTRY[f"top_n_value_{how}_cate_where"] = key, value


for _n in ("count", "sum", "avg", "min", "max"):
    _category(_n)


def _ratio(best: Callable[[Column, object], Column]):
    def ratio(s: Scope, x: Column, cond: Column, category: Column, n) -> Column:
        """Per key the share of its rows that meet the condition."""
        hit = F.when(x.isNotNull(), F.coalesce(cond, F.lit(False)).cast("double"))
        return encode(best(by_category(s, "avg", hit, category), n), s.type_of(category), "double")

    return ratio


REGISTRY["top_n_key_ratio_cate"] = _ratio(top_keys)
REGISTRY["top_n_value_ratio_cate"] = _ratio(top_values)


# ---- lists and places


@aggregate("window_split")
def window_split(s: Scope, x: Column, d: str) -> Column:
    """Parts of the strings of all rows, the newest row's first."""
    from tidemark.functions.scalar import split

    return F.flatten(F.transform(F.reverse(s.list(x)), lambda v: split(v, d)))


@aggregate("window_split_by_key")
def window_split_by_key(s: Scope, x: Column, d: str, kv: str) -> Column:
    from tidemark.functions.scalar import split_by_key

    return F.flatten(F.transform(F.reverse(s.list(x)), lambda v: split_by_key(v, d, kv)))


@aggregate("window_split_by_value")
def window_split_by_value(s: Scope, x: Column, d: str, kv: str) -> Column:
    from tidemark.functions.scalar import split_by_value

    return F.flatten(F.transform(F.reverse(s.list(x)), lambda v: split_by_value(v, d, kv)))


@aggregate("first_value")
def first_value(s: Scope, x: Column, known: bool = False) -> Column:
    """Of the oldest row of the frame."""
    return s.first(x, known)


@aggregate("last_value")
def last_value(s: Scope, x: Column, known: bool = False) -> Column:
    return s.last(x, known)


@aggregate("frame_rows")
def frame_rows(s: Scope, x: Column) -> Column:
    """The values of all rows of the frame, oldest first."""
    return s.rows(x)


@aggregate("lag", "at")
def lag(s: Scope, x: Column, n) -> Column:
    """n rows before the current one in the partition, whatever the frame."""
    if s.frame is None:
        raise ValueError("lag needs a window")
    if s.frame.block_ms is not None:
        raise ValueError("lag looks beyond blocks of time")
    return F.lag(x, int(n)).over(s._ordered("__ms", "__main", *s.frame.tie))
