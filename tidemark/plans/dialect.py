"""Queries of the dialect as DataFrame plans."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from dataclasses import replace as changed

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import aggregates, fingerprint, scalar, signature
from tidemark.operators.features import Feature, group_features, window_features
from tidemark.operators.frames import Frame, interval_ms
from tidemark.operators.frames import Scope as FrameScope
from tidemark.operators.joins import asof_join, last_join
from tidemark.plans.grammar import Call, Join, Literal, Name, Op, Parameter, Select, SetOp, Source, SqlError, Star, WindowSpec, With, parse_query

_SIGNATURES = {"csv", "libsvm", "gcformat"}
_TAGS = {"continuous", "discrete", "binary_label", "multiclass_label", "regression_label", "gcformat_index"}


@dataclass
class Scope:
    """Tables of a FROM clause: alias -> column in lower case -> its name in ``df``, in order."""

    df: DataFrame
    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)  # name in df -> name shown

    def find(self, parts: Sequence[str]) -> str:
        column = parts[-1].lower()
        if len(parts) > 1:
            table = parts[-2].lower()
            if table in self.tables and column in self.tables[table]:
                return self.tables[table][column]
            raise SqlError(f"no column {'.'.join(parts)}")
        found = [t[column] for t in self.tables.values() if column in t]
        if len(found) != 1:
            raise SqlError(f"{'no' if not found else 'more than one'} column {parts[-1]}")
        return found[0]


class ListScope(FrameScope):
    """Aggregates of an array of values of a type."""

    def __init__(self, values: Column, kind: str):
        self.values, self.kind, self.native, self.frame = values, kind, None, None

    def rows(self, value: Column) -> Column:
        return self.values

    def type_of(self, x: Column) -> str:
        return self.kind


class Compiler:
    def __init__(self, spark: SparkSession, tables: Callable[[tuple[str, ...]], DataFrame], parameters: Sequence = ()):
        self.spark, self.tables, self.parameters = spark, tables, list(parameters)
        self.element: Column | None = None  # the row that names stand for, where it isn't the current one

    # ---- queries

    def query(self, q, env: dict[str, DataFrame]) -> DataFrame:
        if isinstance(q, With):
            env = dict(env)
            for name, inner in q.tables:
                env[name.lower()] = self.query(inner, env)
            return self.query(q.query, env)
        if isinstance(q, SetOp):
            parts = [self.query(p, env) for p in q.parts]
            out = parts[0]
            for p in parts[1:]:
                if len(p.columns) != len(out.columns):
                    raise SqlError("the parts of a UNION have different numbers of columns")
                out = out.union(p)
            if q.distinct:
                out = out.distinct()
            if q.order_by:
                out = out.orderBy(*[F.col(f"`{e.parts[-1]}`").desc() if d else F.col(f"`{e.parts[-1]}`") for e, d in q.order_by])
            return out if q.limit is None else out.limit(q.limit)
        return self.select(q, env)

    def table(self, source: Source, env: dict[str, DataFrame], number: int) -> tuple[str, DataFrame, list[str]]:
        """Alias, the table under names that are unique in the query, and its own column names."""
        if isinstance(source.query, tuple):
            name = source.query[-1]
            df = env[name.lower()] if len(source.query) == 1 and name.lower() in env else self.tables(source.query)
        else:
            name, df = f"t{number}", self.query(source.query, env)
        alias = source.alias or name
        return alias.lower(), df.toDF(*[f"c{number}_{i}_{c}" for i, c in enumerate(df.columns)]), df.columns

    def sources(self, q: Select, env: dict[str, DataFrame]) -> Scope:
        if q.source is None:
            return Scope(self.spark.range(1).select(F.lit(1).alias("c0_one")))
        alias, df, columns = self.table(q.source, env, 0)
        scope = Scope(df, {alias: {c.lower(): n for c, n in zip(columns, df.columns)}}, dict(zip(df.columns, columns)))
        for number, j in enumerate(q.joins, 1):
            alias, right, columns = self.table(j.source, env, number)
            if alias in scope.tables:
                raise SqlError(f"two tables are called {alias}")
            scope.tables[alias] = {c.lower(): n for c, n in zip(columns, right.columns)}
            scope.names |= dict(zip(right.columns, columns))
            scope.df = self.join(scope, right, j)
        return scope

    def join(self, scope: Scope, right: DataFrame, j: Join) -> DataFrame:
        left, mine = scope.df, set(scope.df.columns)
        pairs, rest, right_only = [], [], []
        for part in _conjuncts(j.on):
            used = self.columns_of(part, scope)
            if isinstance(part, Op) and part.name == "=" and all(isinstance(a, Name) for a in part.args):
                a, b = (scope.find(x.parts) for x in part.args)
                if (a in mine) != (b in mine):
                    pairs.append((a, b) if a in mine else (b, a))
                    continue
            (rest if used & mine or not used else right_only).append(part)
        both = Scope(left.crossJoin(right), scope.tables) if rest or right_only else scope
        if j.kind == "left":
            cond = [F.col(a) == F.col(b) for a, b in pairs] + [self.value(p, both) for p in (*rest, *right_only)]
            total = cond[0]
            for c in cond[1:]:
                total = total & c
            return left.join(right, total, "left")
        if j.order_by is None:
            order = right.columns[0]  # any match will do; the first column makes it a fixed one
        else:
            order = scope.find(j.order_by)
            if order in mine:
                raise SqlError("LAST JOIN is ordered by a column of its right table")
        where = None
        for p in right_only:
            c = self.value(p, Scope(right, scope.tables))
            where = c if where is None else where & c
        if where is not None:
            right = right.filter(where)
        asof = self.as_of(rest, order, mine, scope) if pairs and j.order_by is not None else None
        if asof is not None:
            kinds = dict(right.dtypes)
            tie = [c for c in right.columns if c != order and not kinds[c].startswith("map")]
            return asof_join(left, right, pairs, asof[0], order, tie, asof[1])
        if rest or not pairs:
            return _last_join_any(left, right, pairs, [self.value(p, both) for p in rest], order)
        return last_join(left, right, pairs, order)

    def as_of(self, rest: list, order: str, mine: set[str], scope: Scope) -> tuple[str, bool] | None:
        """The left column and whether it is strict, if the rest is "right order column before left column"."""
        if len(rest) != 1 or not isinstance(rest[0], Op) or rest[0].name not in ("<", "<=", ">", ">=") or not all(isinstance(a, Name) for a in rest[0].args):
            return None
        a, b = (scope.find(x.parts) for x in rest[0].args)
        early, late = (a, b) if rest[0].name[0] == "<" else (b, a)
        return (late, len(rest[0].name) == 1) if early == order and late in mine else None

    def columns_of(self, e, scope: Scope) -> set[str]:
        if isinstance(e, Name):
            return {scope.find(e.parts)}
        out: set[str] = set()
        for x in _children(e):
            out |= self.columns_of(x, scope)
        return out

    def select(self, q: Select, env: dict[str, DataFrame]) -> DataFrame:
        scope = self.sources(q, env)
        if q.where is not None:
            scope.df = scope.df.filter(self.value(q.where, scope))
        items = self.items(q, scope)
        calls = [c for e, _ in items for c in _calls(e)]
        over = [c for c in calls if c.window is not None]
        plain = [c for c in calls if c.window is None and c.name in aggregates.REGISTRY]
        having = [c for c in _calls(q.having) if c.window is None and c.name in aggregates.REGISTRY] if q.having is not None else []
        if over and (plain or q.group_by):
            raise SqlError("aggregates over windows and over groups don't mix in one SELECT")
        done: dict[Call, Column] = {}
        if plain or having or q.group_by:
            df = self.grouped(q, scope, list(dict.fromkeys([*plain, *having])), done)
        elif over:
            df = self.windowed(q, scope, list(dict.fromkeys(over)), done, env)
        else:
            df = scope.df
        after = Scope(df, scope.tables, scope.names)
        if q.having is not None:
            df = df.filter(self.value(q.having, after, done))
        shown = [(self.value(e, after, done), alias or self.shown(e, scope, n)) for n, (e, alias) in enumerate(items)]
        if q.order_by and not q.distinct:
            aliases = {a.lower(): c for c, a in shown}
            order = [aliases[e.parts[0].lower()] if isinstance(e, Name) and len(e.parts) == 1 and e.parts[0].lower() in aliases else self.value(e, after, done) for e, _ in q.order_by]
            df = df.orderBy(*[o.desc() if d else o.asc() for o, (_, d) in zip(order, q.order_by)])
        out = df.select(*[c.alias(a) for c, a in shown])
        if q.distinct:
            out = out.distinct()
        return out if q.limit is None else out.limit(q.limit)

    def items(self, q: Select, scope: Scope) -> list[tuple]:
        out = []
        for e, alias in q.items:
            if isinstance(e, Star):
                for t, columns in scope.tables.items():
                    if e.table is None or e.table.lower() == t:
                        out += [(Name((t, c)), scope.names[n]) for c, n in columns.items()]
            else:
                out.append((e, alias))
        return out

    def shown(self, e, scope: Scope, number: int) -> str:
        if isinstance(e, Name):
            return e.parts[-1]
        return _text(e)

    def feature(self, call: Call, scope: Scope, alias: str, done: dict) -> Feature:
        args = [F.lit(1) if isinstance(a, Star) else self.argument(a, scope, done) for a in call.args]
        if call.name in ("count", "count_where") or not isinstance(args[0] if args else None, Column):
            args = [a if isinstance(a, Column) or i else F.lit(a) for i, a in enumerate(args)]
        return Feature(call.name, *args, alias=alias)

    def grouped(self, q: Select, scope: Scope, calls: list[Call], done: dict) -> DataFrame:
        keys = [scope.find(g) for g in q.group_by]
        features = [self.feature(c, scope, f"a_{n}", {}) for n, c in enumerate(calls)]
        for c, f in zip(calls, features):
            done[c] = F.col(f.alias)
        if not features:
            return scope.df.select(*keys).distinct()
        # order-sensitive aggregates take the rows of a group by time, then by all columns
        kinds = dict(scope.df.dtypes)
        order = sorted((c for c in scope.df.columns if not kinds[c].startswith("map")), key=lambda c: not kinds[c].startswith("timestamp"))
        return group_features(scope.df, keys, features, order=order)

    def windowed(self, q: Select, scope: Scope, calls: list[Call], done: dict, env: dict[str, DataFrame]) -> DataFrame:
        frames: dict[WindowSpec, list[Feature]] = {}
        for n, c in enumerate(calls):
            spec = c.window if isinstance(c.window, WindowSpec) else q.windows.get(str(c.window).lower())
            if spec is None:
                raise SqlError(f"no window {c.window}")
            if c.name not in aggregates.REGISTRY:
                raise SqlError(f"no aggregate {c.name}")
            inner = [x for a in c.args for x in _calls(a)]
            if inner:
                frames.setdefault(spec, []).extend(self.nested(c, inner, scope, n, done))
                continue
            f = self.feature(changed(c, window=None), scope, f"a_{n}", {})
            frames.setdefault(spec, []).append(f)
            done[c] = F.col(f.alias)
        return window_features(scope.df, [(self.frame(s, scope, env), fs) for s, fs in frames.items()])

    def nested(self, call: Call, inner: list[Call], scope: Scope, number: int, done: dict) -> list[Feature]:
        """A ``*_where`` whose condition compares each row of the frame with aggregates of the same frame."""
        base = call.name.removesuffix("_where")
        if base == call.name or base not in ("count", "sum", "avg", "min", "max"):
            raise SqlError(f"{call.name} takes no aggregate as an argument")
        features, known = [], {}
        for k, x in enumerate(inner):
            features.append(self.feature(x, scope, f"a_{number}_{k}", {}))
            known[x] = F.col(features[-1].alias)
        names = sorted({n for a in call.args for n in self.columns_of(a, scope)})
        features.append(Feature("frame_rows", F.struct(*names), alias=f"a_{number}_rows"))
        value = F.lit(1) if isinstance(call.args[0], Star) else self.value(call.args[0], scope)
        kind = self.type_of(value, scope)

        def of(e: Column, arg) -> Column:
            self.element = e
            try:
                return F.lit(1) if isinstance(arg, Star) else self.value(arg, scope, known)
            finally:
                self.element = None

        rows = F.filter(F.col(features[-1].alias), lambda e: F.coalesce(of(e, call.args[1]), F.lit(False)))
        done[call] = aggregates.REGISTRY[base](ListScope(F.transform(rows, lambda e: of(e, call.args[0])), kind), value)
        return features

    def frame(self, spec: WindowSpec, scope: Scope, env: dict[str, DataFrame]) -> Frame:
        if spec.order_by is None and spec.exclude_current_time:
            raise SqlError("EXCLUDE CURRENT_TIME needs ORDER BY")
        unions = []
        for n, u in enumerate(spec.unions):
            _, df, _ = self.table(u, env, 1000 + n)
            if len(df.columns) != len(scope.df.columns):
                raise SqlError("a table of a window union has other columns than the first")
            unions.append(df.toDF(*scope.df.columns))
        offset = (lambda b: None if b.offset is None else interval_ms(b.offset)) if spec.kind == "rows_range" else (lambda b: b.offset)
        for b in (spec.start, spec.end):
            if spec.kind == "rows" and isinstance(b.offset, str):
                raise SqlError("a time span is no bound of a ROWS frame")
        order = None if spec.order_by is None else scope.find(spec.order_by)
        keys = [scope.find(k) for k in spec.partition_by]
        kinds = dict(scope.df.dtypes)
        tie = [c for c in scope.df.columns if c != order and c not in keys and not kinds[c].startswith("map")]
        return Frame(keys, order, spec.kind, offset(spec.start), offset(spec.end) or 0, spec.start.open and spec.start.offset is not None, spec.end.open, spec.maxsize, spec.exclude_current_row, spec.exclude_current_time, spec.instance_not_in_window, tuple(unions), tuple(tie))

    # ---- expressions

    def type_of(self, c: Column, scope: Scope) -> str:
        return scope.df.select(c.alias("x")).schema["x"].dataType.simpleString()

    def argument(self, e, scope: Scope, done: dict):
        """A literal as it is in Python, anything else as a column."""
        if isinstance(e, Literal) and e.value is not None and not e.kind:
            return e.value
        if isinstance(e, Parameter):
            return self.parameters[e.number]
        return self.value(e, scope, done)

    def value(self, e, scope: Scope, done: dict | None = None) -> Column:
        done = done or {}
        if isinstance(e, Literal):
            if e.kind == "interval":
                return F.lit(interval_ms(e.value)).cast("long")
            out = F.lit(e.value)
            return out.cast(e.kind) if e.kind else out
        if isinstance(e, Parameter):
            return F.lit(self.parameters[e.number])
        if isinstance(e, Name):
            return F.col(f"`{scope.find(e.parts)}`") if self.element is None else self.element[scope.find(e.parts)]
        if isinstance(e, Call):
            return done[e] if e in done else self.call(e, scope, done)
        return self.operator(e, scope, done)

    def call(self, e: Call, scope: Scope, done: dict) -> Column:
        if e.name in _SIGNATURES:
            return getattr(signature, e.name)(*[self.tagged(a, scope, done) for a in e.args])
        if e.name in ("hash64", "farm_fingerprint"):
            x = self.value(e.args[0], scope, done)
            return fingerprint.hash64(x, self.type_of(x, scope))
        args = [self.argument(a, scope, done) for a in e.args]
        if e.name in scalar.REGISTRY:
            return scalar.REGISTRY[e.name](*args)
        return F.call_function(e.name, *[a if isinstance(a, Column) else F.lit(a) for a in args])

    def tagged(self, e, scope: Scope, done: dict) -> signature.Feature:
        if not isinstance(e, Call) or e.name not in _TAGS:
            raise SqlError("sample lines are made of continuous, discrete and label columns")
        x = self.value(e.args[0], scope, done)
        if e.name == "discrete":
            kind = self.type_of(x, scope)
            if len(e.args) == 1:
                return signature.discrete(x, None, kind)
            size = self.argument(e.args[1], scope, done)
            return signature.discrete(x, size if isinstance(size, int) else 0, kind)
        return getattr(signature, e.name)(x)

    def operator(self, e: Op, scope: Scope, done: dict) -> Column:
        v = lambda x: self.value(x, scope, done)
        if e.name == "case":
            out = None
            for cond, then in e.args:
                out = F.when(v(cond), v(then)) if out is None else out.when(v(cond), v(then))
            return out if e.more is None else out.otherwise(v(e.more))
        if e.name in ("like", "ilike"):
            pattern = self.argument(e.args[1], scope, done)
            escape = "\\" if e.more is None else self.argument(e.more, scope, done)
            return (scalar.like_match if e.name == "like" else scalar.ilike_match)(v(e.args[0]), pattern, escape)
        if e.name == "rlike":
            return scalar.regexp_like(v(e.args[0]), self.argument(e.args[1], scope, done))
        args = [v(a) for a in e.args]
        if e.name == "cast" and e.more.startswith("array"):
            return args[0].cast(e.more)
        if e.name == "cast":
            return scalar.REGISTRY["bool"](args[0]) if e.more == "boolean" and self.type_of(args[0], scope) == "string" else scalar.timestamp(args[0]) if e.more == "timestamp" else args[0].try_cast(e.more)
        if e.name == "div":
            kinds = [self.type_of(a, scope) for a in args]
            return scalar.integer_divide(*args).cast("bigint" if "bigint" in kinds else "int")
        if e.name in ("+", "-") and len(args) == 2:
            kinds = [self.type_of(a, scope) if isinstance(x, (Name, Call)) else "" for a, x in zip(args, e.args)]
            if any(k.startswith("timestamp") for k in kinds):
                ms = [F.unix_millis(a.cast("timestamp")) if k.startswith("timestamp") else a for a, k in zip(args, kinds)]
                return F.timestamp_millis(ms[0] + ms[1] if e.name == "+" else ms[0] - ms[1])
        binary = {
            "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": scalar.divide, "%": scalar.remainder,
            "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
            "and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": scalar.xor, "&": lambda a, b: a.bitwiseAND(b), "|": lambda a, b: a.bitwiseOR(b), "^": lambda a, b: a.bitwiseXOR(b),
            "||": lambda a, b: scalar.concat(a, b), "index": lambda a, b: a[b],
        }
        if e.name in binary and len(args) == 2:
            return binary[e.name](*args)
        other = {
            "not": lambda a: ~a, "negate": lambda a: -a, "~": F.bitwise_not, "isnull": lambda a: a.isNull(), "between": lambda a, b, c: a.between(b, c),
            "in": lambda a, *xs: a.isin(*xs), "array": lambda *xs: F.array(*xs), "struct": lambda *xs: scalar.make_tuple(*xs),
        }
        return other[e.name](*args)


def _last_join_any(left: DataFrame, right: DataFrame, pairs: list, conditions: list[Column], order: str) -> DataFrame:
    """LAST JOIN with a condition between both sides, given as a column."""
    there = right.withColumn("__there", F.lit(True))
    once = left.groupBy(*left.columns).agg(F.count(F.lit(1)).alias("__copies"))
    total = None
    for c in [*(F.col(a) == F.col(b) for a, b in pairs), *conditions]:
        total = c if total is None else total & c
    joined = once.join(there, total, "left")
    packed = F.when(F.col("__there"), F.struct(F.col(order).alias("o"), F.struct(*right.columns).alias("row")))
    best = joined.groupBy(*once.columns).agg(F.max(packed).alias("__best")).withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return best.select(*left.columns, *[F.col("__best")["row"][c].alias(c) for c in right.columns])


def _conjuncts(e) -> list:
    return [x for a in e.args for x in _conjuncts(a)] if isinstance(e, Op) and e.name == "and" else [e]


def _children(e) -> list:
    if isinstance(e, Call):
        return list(e.args)
    if isinstance(e, Op):
        flat = [x for a in e.args for x in (a if isinstance(a, tuple) and e.name == "case" else (a,))]
        return flat + ([e.more] if e.more is not None and not isinstance(e.more, str) else [])
    return []


def _calls(e) -> list[Call]:
    """Calls of aggregates in an expression, outermost only."""
    if isinstance(e, Call) and (e.window is not None or e.name in aggregates.REGISTRY):
        return [e]
    return [c for x in _children(e) for c in _calls(x)]


def _text(e) -> str:
    if isinstance(e, Literal):
        return "NULL" if e.value is None else str(e.value)
    if isinstance(e, Name):
        return ".".join(e.parts)
    if isinstance(e, Call):
        return f"{e.name}({', '.join(map(_text, e.args))})" + ("" if e.window is None else f" over {e.window}" if isinstance(e.window, str) else " over ()")
    if isinstance(e, Op):
        return f"{e.name}({', '.join(_text(a) for a in _children(e))})"
    return "*"


def compile_query(spark: SparkSession, text: str, tables: Callable[[tuple[str, ...]], DataFrame], parameters: Sequence = ()) -> DataFrame:
    """A query of the dialect over tables that ``tables`` finds by name (database and table, or table)."""
    return Compiler(spark, tables, parameters).query(parse_query(text), {})
