"""Window frames of the dialect as Spark windows.

A ``Frame`` describes partition, order and extent; ``prepare`` gives the input the helper columns that the
extent needs, and ``Scope`` evaluates aggregates over it. Frames that are one Spark frame (ROWS, ROWS_RANGE,
with OPEN bounds or without the current row) use native aggregates. Those that pick rows within a Spark frame
(MAXSIZE, EXCLUDE CURRENT_TIME, INSTANCE_NOT_IN_WINDOW) are put together for count, sum, avg, min and max: native aggregates of the rows
before the current one, and the current row's own value. Other aggregates over them collect the values of the smallest native frame that
holds them, and aggregate the array.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.timeutil import floor_div, millis

#: Rows of a partition with the same time are told apart by adding their number; at most this many.
PEERS = 1 << 20
UNITS = {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def interval_ms(text: str | int) -> int:
    """``10s``, ``5m``, ``3h``, ``1d`` or plain milliseconds."""
    text = str(text).strip()
    return int(text[:-1]) * UNITS[text[-1].lower()] if text[-1].lower() in UNITS else int(text)


def wrapped(total: Column, kind: str) -> Column:
    """A total as ``kind``, wrapped around where it doesn't fit."""
    bits = {"tinyint": 8, "smallint": 16, "int": 32}.get(kind)
    if bits:
        total = F.pmod(total + F.lit(1 << bits - 1), F.lit(1 << bits)) - F.lit(1 << bits - 1)
    return total.cast(kind)


@dataclass(frozen=True)
class Frame:
    """``kind`` is ``rows`` or ``rows_range``; ``start`` and ``end`` are offsets before the current row (None: unbounded; ms for a range).

    ``tie`` are columns that make the order of equal times total. ``unions`` are tables whose rows are in the
    window but give no output; on equal times they come before the rows of the table itself.

    ``block_ms`` splits every key's rows into blocks, for keys that hold much of the table: a block is computed
    apart, with the rows before it that its windows reach. It goes with frames that have a start. ROWS_RANGE frames
    are split by time; ROWS frames into blocks of ``block_rows`` rows, whose numbers come from counts per ``block_ms``.
    """

    partition_by: Sequence[str]
    order_by: str | None
    kind: str = "rows"
    start: int | None = None
    end: int = 0
    start_open: bool = False
    end_open: bool = False
    maxsize: int | None = None
    exclude_current_row: bool = False
    exclude_current_time: bool = False
    instance_not_in_window: bool = False
    unions: Sequence[DataFrame] = field(default=(), hash=False)
    tie: Sequence[str] = ()
    block_ms: int | None = None
    block_rows: int = 1 << 16

    def __post_init__(self):
        if self.kind not in ("rows", "rows_range"):
            raise ValueError("a frame is rows or rows_range")
        if self.maxsize is not None and self.kind == "rows":
            raise ValueError("MAXSIZE goes with ROWS_RANGE only")
        if self.block_ms is not None and (self.start is None or self.block_ms < 1):
            raise ValueError("only frames with a start can be split into blocks")
        if self.block_ms is not None and self.kind == "rows" and (self.exclude_current_time or self.instance_not_in_window):
            raise ValueError("a ROWS frame that skips rows can't be split into blocks")
        if self.end < 0 or self.start is not None and self.start < self.end:
            raise ValueError("a frame lies before the current row and starts before its end")

    def rows(self, start: int | None, end: int = 0, **more) -> Frame:
        return replace(self, kind="rows", start=start, end=end, **more)

    def rows_range(self, start: str | int | None, end: str | int = 0, **more) -> Frame:
        return replace(self, kind="rows_range", start=None if start is None else interval_ms(start), end=interval_ms(end), **more)


def shared(frame: Frame) -> tuple:
    """Frames with the same of this can be evaluated over one preparation of their rows."""
    split = id(frame) if frame.block_ms is not None else None
    return tuple(frame.partition_by), frame.order_by, tuple(frame.tie), tuple(map(id, frame.unions)), split


def prepare(df: DataFrame, frame: Frame, *others: Frame) -> DataFrame:
    """The rows of ``df`` and of the frame's union tables, with helper columns; rows without a valid time are left out.

    ``__main`` is false for rows of union tables, ``__ms`` the time, ``__seq`` a total order of each time's
    rows, ``__key`` time and order in one number. A column that a union table lacks is an error. ``others`` are frames
    that share the rows.
    """
    every = (frame, *others)
    out = df.withColumn("__main", F.lit(True))
    for u in frame.unions:
        if len(u.columns) != len(df.columns):
            raise ValueError("a table of a window union has other columns than the first")
        out = out.union(u.toDF(*df.columns).withColumn("__main", F.lit(False)))
    out = out.withColumn("__ms", millis(out, frame.order_by) if frame.order_by else F.lit(0).cast("long"))
    out = out.filter(F.col("__ms") >= 0).withColumn("__out", F.col("__main"))
    by = list(frame.partition_by)
    if frame.block_ms is not None and frame.kind == "rows":
        out = _row_blocks(out, frame)
        by.append("__block")
    elif frame.block_ms is not None:
        # a row is in its own block, and for context in each later one whose windows still reach it
        own, reached = floor_div(F.col("__ms"), frame.block_ms), floor_div(F.col("__ms") + frame.start, frame.block_ms)
        out = out.withColumn("__block", F.explode(F.sequence(own, reached))).withColumn("__out", F.col("__main") & (F.col("__block") == own))
        by.append("__block")
    order = ["__main", *frame.tie]
    if any(f.kind == "rows_range" or f.exclude_current_time or f.instance_not_in_window for f in every):
        # both numbers over the same partition and sort as the frames themselves: no shuffle of their own
        seq = (F.row_number().over(Window.partitionBy(*by).orderBy("__ms", *order)) - F.rank().over(Window.partitionBy(*by).orderBy("__ms"))).cast("long")
        # the peers' number must fit in the key; a key with more would give wrong frames, so it is an error
        out = out.withColumn("__seq", F.when(seq < PEERS // 2, seq).otherwise(F.raise_error(F.lit(f"more than {PEERS // 2} rows of one key and time"))))
        out = out.withColumn("__key", F.col("__ms") * PEERS + F.col("__seq"))
    if any(f.instance_not_in_window for f in every):
        so_far = Window.partitionBy(*by).orderBy("__key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn("__union_rows", F.count(F.when(~F.col("__main"), 1)).over(so_far))
    return out


def _row_blocks(df: DataFrame, frame: Frame) -> DataFrame:
    """Rows in blocks of ``block_rows`` of their key, each with the ``start`` rows before it for context.

    A row's number in its key is the number of rows in earlier spans of ``block_ms``, from a small table of counts, and its
    number in its span. So no task sees more of a key than a span or a block.
    """
    keys, size = list(frame.partition_by), max(frame.block_rows, frame.start or 1)
    df = df.withColumn("__span", floor_div(F.col("__ms"), frame.block_ms))
    counts = df.groupBy(*keys, "__span").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__span").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = F.col("__span") == F.col("__s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    within = F.row_number().over(Window.partitionBy(*keys, "__span").orderBy("__ms", "__main", *frame.tie))
    at = df.withColumn("__within", within).join(counts, same).withColumn("__number", F.col("__before") + F.col("__within") - 1)
    own = floor_div(F.col("__number"), size)
    more = F.when(F.col("__number") >= (own + 1) * size - frame.start, F.array(own, own + 1)).otherwise(F.array(own))
    at = at.withColumn("__block", F.explode(more)).withColumn("__out", F.col("__main") & (F.col("__block") == own))
    return at.drop(*[f"__k{i}" for i in range(len(keys))], "__s", "__before", "__within", "__number", "__span")


def finish(df: DataFrame) -> DataFrame:
    """Output rows only, without helper columns."""
    return df.filter("__out").drop(*[c for c in df.columns if c.startswith("__")])


class Scope:
    """Aggregates over a frame of ``prepare``d rows, or over groups.

    An aggregate may add helper columns to ``df``, so its column belongs to ``df`` as it is afterwards.
    """

    def __init__(self, df: DataFrame, frame: Frame | None = None, order: Sequence[str] = ()):
        """Without a frame, of a group; ``order`` are then the columns that say which row is oldest."""
        if frame is not None and frame.block_ms is not None:
            frame = replace(frame, partition_by=[*frame.partition_by, "__block"])
        self.df, self.frame, self.order = df, frame, list(order)
        self.native: Callable[[Column], Column] | None = None
        if frame is None:
            self.native = lambda c: c
        elif not (frame.maxsize is not None or frame.exclude_current_time or frame.instance_not_in_window):
            spec = self._spec()
            self.native = lambda c: c.over(spec)

    def type_of(self, x: Column) -> str:
        return self.df.select(x.alias("x")).schema["x"].dataType.simpleString()

    def _ordered(self, *by: str) -> WindowSpec:
        return Window.partitionBy(*self.frame.partition_by).orderBy(*by)

    def _spec(self) -> WindowSpec:
        f = self.frame
        if f.kind == "rows":
            start = Window.unboundedPreceding if f.start is None else -(f.start - f.start_open)
            end = -(f.end + f.end_open)
            if f.exclude_current_row:
                end = min(end, -1)
            return self._ordered("__ms", "__main", *f.tie).rowsBetween(start, end)
        start = None if f.start is None else f.start - f.start_open
        first = Window.unboundedPreceding if start is None else -(start * PEERS + PEERS // 2)
        if f.end or f.end_open:
            return self._ordered("__key").rangeBetween(first, -(f.end + f.end_open) * PEERS + PEERS // 2)
        return self._ordered("__key").rangeBetween(first, -1 if f.exclude_current_row else 0)

    def rows(self, value: Column) -> Column:
        """Values of the frame's rows, oldest first, NULL included."""
        if self.frame is None:
            if not self.order:
                return F.transform(F.collect_list(F.struct(value.alias("v"))), lambda e: e["v"])
            return F.transform(F.array_sort(F.collect_list(F.struct(*self.order, value.alias("v")))), lambda e: e["v"])
        entry = F.struct(F.col("__ms").alias("ms"), value.alias("v"))
        if self.native:
            return F.transform(self.native(F.collect_list(entry)), lambda e: e["v"])
        f, now = self.frame, F.col("__ms")
        start = None if f.start is None else f.start - f.start_open
        near = lambda e: F.lit(True) if start is None or f.kind == "rows" else e["ms"] >= now - start
        old = lambda e: e["ms"] <= now - (f.end + f.end_open) if f.kind == "rows_range" else F.lit(True)
        if f.instance_not_in_window:
            # the last n rows of union tables up to here: their running number is the order
            n = f.maxsize if f.kind == "rows_range" else f.start
            others = n if n is None or f.exclude_current_row or f.kind == "rows" else n - 1
            spec = Window.partitionBy(*f.partition_by).orderBy("__union_rows").rangeBetween(Window.unboundedPreceding if others is None else -(others - 1), 0) if others != 0 else None
            if f.kind == "rows_range" and f.maxsize is None and start is not None:
                spec = self._ordered("__key").rangeBetween(-(start * PEERS + PEERS // 2), 0)
            past = F.array().cast(f"array<struct<ms:bigint,v:{self.type_of(value)}>>") if spec is None else F.collect_list(F.when(~F.col("__main"), entry)).over(spec)
            if f.kind == "rows" and f.end:
                past = F.slice(past, F.lit(1), F.greatest(F.size(past) - (f.end - 1), F.lit(0)))
        elif f.exclude_current_time:
            if f.kind == "rows":
                # what comes before the first row of a time, carried to the others of that time
                before = F.collect_list(entry).over(self._ordered("__key").rowsBetween(Window.unboundedPreceding if start is None else -start, -1))
                name = f"__before{len(self.df.columns)}"
                self.df = self.df.withColumn(name, before)
                past = F.first(name).over(Window.partitionBy(*f.partition_by, "__ms").orderBy("__seq"))
            else:
                past = F.collect_list(entry).over(self._ordered("__key").rangeBetween(Window.unboundedPreceding if start is None else -(start * PEERS + PEERS // 2), -(PEERS // 2)))
                if f.maxsize is not None:
                    keep = f.maxsize if f.exclude_current_row else f.maxsize - 1
                    past = F.slice(past, F.greatest(F.size(past) - keep + 1, F.lit(1)), F.lit(keep)) if keep else F.slice(past, 1, 0)
        else:
            others = f.maxsize if f.exclude_current_row else f.maxsize - 1
            if f.end or f.end_open:
                # pure history: the newest rows at or before the end
                past = F.collect_list(entry).over(self._spec())
                past = F.slice(past, F.greatest(F.size(past) - f.maxsize + 1, F.lit(1)), F.lit(f.maxsize))
            elif others:
                past = F.collect_list(entry).over(self._ordered("__key").rowsBetween(-others, -1))
            else:
                past = F.array().cast(f"array<struct<ms:bigint,v:{self.type_of(value)}>>")
        past = F.filter(past, lambda e: near(e) & old(e))
        values = F.transform(past, lambda e: e["v"])
        if f.exclude_current_row or f.end or f.end_open:
            return values
        return F.concat(values, F.array(value))

    # ---- aggregates put together from native ones

    def _pieces(self) -> list[WindowSpec] | None:
        """Native frames of the rows before the current one, for frames that pick rows. The frame has the rows of all of them, which is those of the
        smallest, as each holds the newest rows up to some point. None where arrays are needed; an empty list where no such row is in the frame."""
        f = self.frame
        if f is None or self.native or f.maxsize is not None and (f.end or f.end_open or f.exclude_current_time):
            return None
        start = None if f.start is None else f.start - f.start_open
        first = Window.unboundedPreceding if start is None else -(start * PEERS + PEERS // 2)
        others = None if f.maxsize is None else f.maxsize if f.exclude_current_row else f.maxsize - 1
        if others == 0:
            return []
        ended = bool(f.end or f.end_open)
        if f.instance_not_in_window:
            numbered = Window.partitionBy(*f.partition_by).orderBy("__union_rows")
            if f.kind == "rows":
                if f.start == 0:
                    return []
                return [numbered.rangeBetween(Window.unboundedPreceding if f.start is None else -(f.start - 1), -max(f.end - 1, 0))]
            timed = self._spec() if ended else self._ordered("__key").rangeBetween(first, 0)
            return [timed] if others is None else [timed, numbered.rangeBetween(-(others - 1), 0)]
        if f.exclude_current_time:
            if f.kind == "rows":
                return [] if start == 0 else [self._ordered("__key").rowsBetween(Window.unboundedPreceding if start is None else -start, -1)] if not ended else None
            return [self._spec() if ended else self._ordered("__key").rangeBetween(first, -(PEERS // 2))]
        return [self._ordered("__key").rangeBetween(first, -1), self._ordered("__key").rowsBetween(-others, -1)]

    def _past(self, pieces: list[WindowSpec], f: Callable[[Column], Column], value: Column) -> Column:
        """An aggregate of the rows before the current one; NULL where there is no such row."""
        if not pieces:
            return F.lit(None)
        picked, one = value, F.lit(1)
        if self.frame.instance_not_in_window:
            picked, one = F.when(~F.col("__main"), value), F.when(~F.col("__main"), 1)
        found = f(picked).over(pieces[0])
        if len(pieces) > 1:
            return F.when(F.count(one).over(pieces[0]) <= F.count(one).over(pieces[1]), found).otherwise(f(picked).over(pieces[1]))
        if self.frame.exclude_current_time and self.frame.kind == "rows" and not self.frame.instance_not_in_window:
            # what comes before the first row of a time holds for the others of that time
            name = f"__before{len(self.df.columns)}"
            self.df = self.df.withColumn(name, found)
            return F.first(name).over(Window.partitionBy(*self.frame.partition_by, "__ms").orderBy("__seq"))
        return found

    def _own(self, value: Column) -> Column:
        f = self.frame
        return F.lit(None).cast(self.type_of(value)) if f.exclude_current_row or f.end or f.end_open else value

    def list(self, value: Column) -> Column:
        """Known values, oldest first."""
        return F.filter(self.rows(value), lambda v: v.isNotNull())

    # ---- base aggregates: native where the frame is, of an array where it isn't

    def count(self, value: Column) -> Column:
        if self.native:
            return self.native(F.count(value))
        pieces = self._pieces()
        if pieces is None:
            return F.size(self.list(value)).cast("long")
        return F.coalesce(self._past(pieces, F.count, value).cast("long"), F.lit(0)) + F.when(self._own(value).isNotNull(), F.lit(1)).otherwise(F.lit(0))

    def _total(self, value: Column, pieces: list[WindowSpec]) -> Column:
        past, own = self._past(pieces, F.sum, value).cast(self.type_of(value)), self._own(value)
        return F.coalesce(past + own, past, own)

    def sum(self, value: Column) -> Column:
        """Keeps the type and wraps around like it; NULL without a known value."""
        kind = self.type_of(value)
        wide = "double" if kind in ("float", "double") else "bigint"
        if self.native:
            return wrapped(self.native(F.sum(value.cast(wide))), kind)
        pieces = self._pieces()
        if pieces is not None:
            return wrapped(self._total(value.cast(wide), pieces), kind)
        xs = self.list(value)
        return wrapped(F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0).cast(wide), lambda a, x: a + x.cast(wide))), kind)

    def avg(self, value: Column) -> Column:
        value = value.cast("double")
        if self.native:
            return self.native(F.avg(value))
        pieces = self._pieces()
        if pieces is not None:
            return self._total(value, pieces) / F.nullif(self.count(value), F.lit(0))
        xs = self.list(value)
        return F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs))

    def min(self, value: Column) -> Column:
        return self._extreme(value, F.min, F.array_min, F.least)

    def max(self, value: Column) -> Column:
        return self._extreme(value, F.max, F.array_max, F.greatest)

    def _extreme(self, value: Column, native: Callable, of_array: Callable, of_two: Callable) -> Column:
        if self.native:
            return self.native(native(value))
        pieces = self._pieces()
        if pieces is None:
            return of_array(self.list(value))
        return of_two(self._past(pieces, native, value).cast(self.type_of(value)), self._own(value))

    def variance(self, value: Column, sample: bool) -> Column:
        value = value.cast("double")
        if self.native:
            return self.native(F.var_samp(value) if sample else F.var_pop(value))
        xs = self.list(value)
        n = F.size(xs)
        mean = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / n
        square = F.aggregate(F.transform(xs, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
        return F.when(n > (1 if sample else 0), square / (n - (1 if sample else 0)))

    def first(self, value: Column, known: bool) -> Column:
        if self.native and self.frame is not None:
            return self.native(F.first(value, ignorenulls=known))
        return F.try_element_at(self.list(value) if known else self.rows(value), F.lit(1))

    def last(self, value: Column, known: bool) -> Column:
        if self.native and self.frame is not None:
            return self.native(F.last(value, ignorenulls=known))
        return F.try_element_at(self.list(value) if known else self.rows(value), F.lit(-1))
