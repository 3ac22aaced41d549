"""Joins that keep every row of the left side: with its latest match, with the match as of its time, with all matches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.timeutil import DAY_US, floor_div, micros


def _pairs(on: Sequence[str | tuple[str, str]]) -> list[tuple[str, str]]:
    return [(k, k) if isinstance(k, str) else tuple(k) for k in on]


def _equal(on: Sequence[tuple[str, str]], prefix: str) -> Column:
    return reduce(Column.__and__, (F.col(a) == F.col(f"{prefix}{i}") for i, (_, _) in enumerate(on) for a in [on[i][0]]))


def _named(right: DataFrame, left: DataFrame, columns: Sequence[str] | None, suffix: str) -> dict[str, str]:
    """Right columns that go into the result, with their names there; a name the left side has gets the suffix."""
    taken, out = set(left.columns), {}
    for c in columns or right.columns:
        name = c
        while name in taken:
            name += suffix
        taken.add(name)
        out[c] = name
    return out


def last_join(left: DataFrame, right: DataFrame, on: Sequence[str | tuple[str, str]], order_by: str, tie: Sequence[str] = (), where: Column | None = None, columns: Sequence[str] | None = None, suffix: str = "_r") -> DataFrame:
    """Each left row with the matching right row that is greatest by ``order_by`` (then ``tie``, then all columns), or NULLs.

    Keys are equal column pairs; a NULL key matches nothing. ``where`` is a condition on right columns only. A
    NULL order is the least. Left rows stay as they are, duplicates included. The right side is reduced to one
    row per key before the join, combined before its shuffle, so nothing multiplies and a hot key of the right
    side costs one row per task; a hot key of the left side is left to the adaptive skew join.
    """
    on = _pairs(on)
    names = _named(right, left, columns, suffix)
    rows = right if where is None else right.filter(where)
    order = [order_by, *tie]
    packed = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*[F.col(c).alias(n) for c, n in names.items()]).alias("row"))
    best = rows.groupBy(*[F.col(b).alias(f"__k{i}") for i, (_, b) in enumerate(on)]).agg(F.max(packed).alias("__best"))
    joined = left.join(best, _equal(on, "__k"), "left")
    return joined.select(*[left[c] for c in left.columns], *[F.col("__best")["row"][n].alias(n) for n in names.values()])


def last_join_where(left: DataFrame, right: DataFrame, on: Sequence[str | tuple[str, str]], condition: str, order_by: str, tie: Sequence[str] = (), columns: Sequence[str] | None = None, suffix: str = "_r") -> DataFrame:
    """The same for any condition between both sides, written in SQL over ``l.`` and ``r.`` columns.

    A condition of equalities, conditions on one side and at most one comparison of a right with a left expression is
    answered without building a pair: both sides are put in the order of what is compared, and the greatest right row so far is
    carried along. Of timestamps the order is kept within blocks, so a hot key's work is split; of other types a key is one task's.
    Any other condition is tried on all pairs of equal keys, one after the other; only the place of the greatest match in the
    order of its key is kept of them, so they take time and no disk.
    """
    names = _named(right, left, columns, suffix)
    # columns of their own for each side, else those of a table joined with itself would be renamed within the join
    l, r = (df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns]).alias(side) for df, side in ((left, "l"), (right, "r")))
    packed = F.struct(*[F.col(f"r.`{c}`").alias(f"o{i}") for i, c in enumerate([order_by, *tie])], F.struct(*[F.col(f"r.`{c}`").alias(n) for c, n in names.items()]).alias("row"))
    whole = reduce(Column.__and__, [*(F.col(f"l.`{a}`") == F.col(f"r.`{b}`") for a, b in _pairs(on)), F.expr(condition)])
    parts = _apart(l, r, whole)
    if parts.rest or len(parts.compared) > 1 or not _plain(l, r, parts):
        return _best_of_pairs(l, r, parts.equal, whole, packed, list(names.values()))
    return _best_so_far(l, r, parts, packed, list(names.values()))


class _Parts(NamedTuple):
    """A condition between two sides. Expressions of the left side come first, compared ones as (left, right, name of the comparison from the right to the left)."""

    equal: list[tuple[Column, Column]]
    compared: list[tuple[Column, Column, str]]
    left: list[Column]
    right: list[Column]
    rest: bool


_TURNED = {"LessThan": "GreaterThan", "LessThanOrEqual": "GreaterThanOrEqual", "GreaterThan": "LessThan", "GreaterThanOrEqual": "LessThanOrEqual"}


def _apart(l: DataFrame, r: DataFrame, whole: Column) -> _Parts:
    """The condition's parts as Spark resolves them, so with the casts that make both sides of a comparison one type."""
    jvm = l.sparkSession._jvm.org.apache.spark.sql
    plan = l.join(r, whole)._jdf.queryExecution().analyzed()
    mine, theirs = plan.left().outputSet(), plan.right().outputSet()
    column = lambda e: Column(jvm.classic.ExpressionUtils.column(e))
    out, todo, rest = _Parts([], [], [], [], False), [plan.condition().get()], False
    while todo:
        e = todo.pop()
        kind, used = e.getClass().getSimpleName(), e.references()
        if kind == "And":
            todo += [e.right(), e.left()]
        elif jvm.catalyst.expressions.SubqueryExpression.hasSubquery(e):
            rest = True
        elif used.subsetOf(mine):
            out.left.append(column(e))
        elif used.subsetOf(theirs):
            out.right.append(column(e))
        elif kind != "EqualTo" and kind not in _TURNED:
            rest = True
        else:
            a, b = e.left(), e.right()
            if a.references().subsetOf(theirs) and b.references().subsetOf(mine):
                a, b = b, a
            elif a.references().subsetOf(mine) and b.references().subsetOf(theirs):
                kind = _TURNED.get(kind, kind)
            else:
                rest = True
                continue
            if kind == "EqualTo":
                out.equal.append((column(a), column(b)))
            else:
                out.compared.append((column(a), column(b), kind))
    return out._replace(rest=rest)


def _plain(l: DataFrame, r: DataFrame, parts: _Parts) -> bool:
    """Whether what is equal or compared is of one type without parts on both sides, so that both sides can stand in one column."""
    pairs = [*parts.equal, *(x[:2] for x in parts.compared)]
    kinds = [[f.dataType for f in df.select(*[p[i] for p in pairs]).schema] for i, df in enumerate((l, r))]
    return kinds[0] == kinds[1] and all(isinstance(k, T.AtomicType) for k in kinds[0])


def _best_so_far(l: DataFrame, r: DataFrame, parts: _Parts, packed: Column, names: list[str]) -> DataFrame:
    """Each left row with the greatest of the right rows that come before it in the order of what is compared."""
    keys = [f"__k{i}" for i in range(len(parts.equal))]
    mine, theirs, kind = parts.compared[0] if parts.compared else (F.lit(0), F.lit(0), "LessThanOrEqual")
    strict, up = not kind.endswith("OrEqual"), kind.startswith("Less")
    for c in parts.right:
        r = r.filter(c)
    if parts.left:
        mine = F.when(reduce(Column.__and__, parts.left), mine)
    none = F.lit(None).cast(r.select(packed.alias("p")).schema["p"].dataType)
    a = l.select(*[x.alias(k) for k, (x, _) in zip(keys, parts.equal)], mine.alias("__at"), F.lit(0 if strict else 1).alias("__side"), F.struct(*[F.col(f"l.`{c}`").alias(c) for c in l.columns]).alias("__left"), none.alias("__best"))
    b = r.select(*[y.alias(k) for k, (_, y) in zip(keys, parts.equal)], theirs.alias("__at"), F.lit(1 if strict else 0).alias("__side"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), packed.alias("__best"))
    whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in [*keys, "__at"]])
    rows, turn = a.filter(whole).unionByName(b.filter(whole)), F.asc if up else F.desc
    blocks = ["__b"] if isinstance(rows.schema["__at"].dataType, (T.TimestampType, T.TimestampNTZType)) else []
    if blocks:
        rows = rows.withColumn("__b", floor_div(micros(rows, "__at"), DAY_US))
    within = Window.partitionBy(*keys, *blocks).orderBy(turn("__at"), "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("__here", F.max("__best").over(within)).filter(F.col("__left").isNotNull()).select(*keys, *blocks, "__left", F.col("__here").alias("__match"))
    if blocks:  # and the greatest of the blocks before, each combined before its shuffle
        ends = rows.groupBy(*keys, "__b").agg(F.max("__best").alias("__end"))
        before = Window.partitionBy(*keys).orderBy(turn("__b")).rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*keys, "__b", F.max("__end").over(before).alias("__past"))
        found = found.join(carried, [*keys, "__b"], "left").withColumn("__match", F.greatest("__match", "__past"))
    found = found.select("__left", "__match").unionByName(a.filter(~F.coalesce(whole, F.lit(False))).select("__left", none.alias("__match")))
    return found.select("__left.*", *[F.col("__match")["row"][n].alias(n) for n in names])


def _best_of_pairs(l: DataFrame, r: DataFrame, equal: list[tuple[Column, Column]], whole: Column, packed: Column, names: list[str]) -> DataFrame:
    """Each left row with the greatest of all right rows that meet the condition.

    Equal left rows are joined once and multiplied afterwards, which needs no row numbers. The greatest match is a number, its
    rank among the right rows of its key: such a maximum is kept in a hash table, while one of rows would sort all pairs.
    """
    keys = [f"__k{i}" for i in range(len(equal))]
    columns = [f"`{c}`" for c in l.columns]
    once = l.select("*", *[x.alias(k) for k, (x, _) in zip(keys, equal)]).groupBy(*columns, *keys).agg(F.count(F.lit(1)).alias("__copies"))
    order = Window.partitionBy(*keys).orderBy("__packed")
    numbered = r.select("*", packed.alias("__packed"), *[y.alias(k) for k, (_, y) in zip(keys, equal)])
    numbered = numbered.filter(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys], F.lit(True))).withColumns({"__rank": F.rank().over(order), "__nth": F.row_number().over(order)})
    a, b = once.alias("l"), numbered.alias("r")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    tried = a.join(b, reduce(Column.__and__, [*same, whole]), "left")
    best = tried.groupBy(*[F.col(f"l.{c}") for c in [*columns, *keys, "__copies"]]).agg(F.max("r.__rank").alias("__rank")).alias("l")
    first = numbered.filter("__nth = __rank").select(*keys, "__rank", "__packed").alias("r")  # one of equal rows
    joined = best.join(first, reduce(Column.__and__, [*same, F.col("l.__rank") == F.col("r.__rank")]), "left")
    every = joined.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return every.select(*[F.col(f"l.{c}") for c in columns], *[F.col("r.__packed")["row"][n].alias(n) for n in names])


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str | tuple[str, str]], left_time: str, right_time: str, tie: Sequence[str] = (), strict: bool = False, columns: Sequence[str] | None = None, suffix: str = "_r", block_us: int = DAY_US) -> DataFrame:
    """Each left row with the latest right row at or before its time (``strict``: before it), or NULLs.

    Both sides are put in one order of time per key, and the last right row seen is carried forward: no pair of rows is ever
    built. The order is kept within blocks of time, and the last right row of earlier blocks is carried to each
    block apart, so a hot key's work is split by time. NULL keys or times match nothing; those left rows stay.
    """
    on = _pairs(on)
    names = _named(right, left, columns, suffix)
    keys = [f"__k{i}" for i in range(len(on))]
    row_type = right.select(F.struct(*[F.col(c).alias(n) for c, n in names.items()]).alias("r"))
    none = F.lit(None).cast(row_type.schema["r"].dataType)
    order = F.struct(*[F.col(c) for c in tie]) if tie else F.lit(None).cast("int")
    order_type = right.select(order.alias("o")).schema["o"].dataType
    a = left.select(*[F.col(x).alias(k) for k, (x, _) in zip(keys, on)], micros(left, left_time).alias("__t"), F.lit(0 if strict else 1).alias("__side"), F.lit(None).cast(order_type).alias("__o"), F.struct(*left.columns).alias("__left"), none.alias("__right"))
    left_type = a.schema["__left"].dataType
    b = right.select(*[F.col(y).alias(k) for k, (_, y) in zip(keys, on)], micros(right, right_time).alias("__t"), F.lit(1 if strict else 0).alias("__side"), order.alias("__o"), F.lit(None).cast(left_type).alias("__left"), F.struct(*[F.col(c).alias(n) for c, n in names.items()]).alias("__right"))
    whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in [*keys, "__t"]])
    b = b.filter(whole)
    rows = a.filter(whole).unionByName(b).withColumn("__b", floor_div(F.col("__t"), block_us))
    within = Window.partitionBy(*keys, "__b").orderBy("__t", "__side", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("__here", F.last("__right", ignorenulls=True).over(within)).filter(F.col("__left").isNotNull()).select(*keys, "__b", "__left", "__here")
    # the last right row of each block, NULL where it has none, combined before its shuffle; then that of the blocks before
    ends = rows.groupBy(*keys, "__b").agg(F.max(F.when(F.col("__right").isNotNull(), F.struct("__t", "__o", "__right"))).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "__b", F.last(F.col("__end")["__right"], ignorenulls=True).over(before).alias("__past"))
    found = seen.join(carried, [*keys, "__b"], "left").select("__left", F.coalesce("__here", "__past").alias("__match"))
    found = found.unionByName(a.filter(~F.coalesce(whole, F.lit(False))).select("__left", none.alias("__match")))
    return found.select("__left.*", *[F.col("__match")[n].alias(n) for n in names.values()])


def left_join(left: DataFrame, right: DataFrame, on: Sequence[str | tuple[str, str]], columns: Sequence[str] | None = None, suffix: str = "_r") -> DataFrame:
    """Each left row with all its matches; the adaptive planner chooses how."""
    on = _pairs(on)
    names = _named(right, left, columns, suffix)
    rows = right.select(*[F.col(b).alias(f"__k{i}") for i, (_, b) in enumerate(on)], *[F.col(c).alias(n) for c, n in names.items()])
    return left.join(rows, _equal(on, "__k"), "left").drop(*[f"__k{i}" for i in range(len(on))])
