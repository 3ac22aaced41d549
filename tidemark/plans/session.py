"""A session: databases and tables, statements of the dialect, deployed queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import aggregates, own, scalar
from tidemark.operators.features import request_frame
from tidemark.operators.frames import interval_ms, wrapped
from tidemark.operators.preagg import build_buckets, long_window
from tidemark.operators.ttl import retain
from tidemark.plans.dialect import Compiler, Scope, _calls, compile_query
from tidemark.plans.grammar import Literal, Parser, Select, SetOp, SqlError, Star, WindowSpec, With, parse_query
from tidemark.sources.files import Options, read, write
from tidemark.timeutil import millis


@dataclass
class Index:
    keys: list[str]
    time: str | None = None
    ttl: int = 0
    ttl_rows: int = 0
    ttl_kind: str = "absolute"
    name: str = ""


@dataclass
class Table:
    """A table: its columns, indexes, and where its rows are (files of its own, external files, or a DataFrame)."""

    schema: T.StructType
    indexes: list[Index] = field(default_factory=list)
    required: list[str] = field(default_factory=list)
    defaults: dict[str, object] = field(default_factory=dict)
    path: str | None = None
    external: list[str] = field(default_factory=list)
    frame: DataFrame | None = None


class Session:
    """Statements over one Spark session.

    Tables written to are kept as parquet below ``root``, which on a cluster must be a folder that all executors
    share. Without ``root`` a folder in ``spark.checkpoint.dir`` is taken.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        base = root or spark.conf.get("spark.checkpoint.dir", None)
        self.root = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}" if base else None
        self.databases: dict[str, dict[str, Table]] = {"default": {}}
        self.current = "default"
        self.deployments: dict[str, str] = {}
        self.procedures: dict[str, T.StructType] = {}
        self.functions: dict[str, str] = {}  # of this session: name -> how it is declared
        self.long_windows: dict[str, dict[str, int]] = {}  # deployment -> window -> ms of a bucket
        self.variables: dict[str, object] = {"execute_mode": "offline"}

    # ---- tables

    def register(self, name: str, df: DataFrame, database: str | None = None) -> None:
        """Makes a DataFrame a table."""
        self.databases[database or self.current][name.lower()] = Table(df.schema, frame=df)

    def find(self, name: Sequence[str]) -> Table:
        database = name[-2].lower() if len(name) > 1 else self.current
        try:
            return self.databases[database][name[-1].lower()]
        except KeyError:
            raise SqlError(f"no table {'.'.join(name)}") from None

    def table(self, name: Sequence[str]) -> DataFrame:
        t = self.find(name)
        parts = [t.frame] if t.frame is not None else []
        if t.path:
            parts.append(self.spark.read.schema(t.schema).parquet(t.path))
        for p in t.external:
            parts.append(read(self.spark, p, Options(format="parquet"), t.schema))
        if not parts:
            return self.spark.createDataFrame([], t.schema)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def expire(self, name: Sequence[str], now_ms: int) -> DataFrame:
        """What the table still holds at a time by the retention of its first index."""
        t = self.find(name)
        if not t.indexes or not t.indexes[0].time:
            return self.table(name)
        i = t.indexes[0]
        return retain(self.table(name), i.keys, i.time, i.ttl_kind, now_ms, i.ttl * 60_000, i.ttl_rows)

    def _append(self, t: Table, rows: DataFrame, put_if_absent: bool = False, name: Sequence[str] = ()) -> None:
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in t.schema])
        if put_if_absent:
            rows = rows.exceptAll(self.table(name).select(*rows.columns)).distinct() if (t.path or t.frame is not None or t.external) else rows.distinct()
        if not self.root:
            t.frame = rows if t.frame is None else t.frame.unionByName(rows)
            return
        t.path = t.path or f"{self.root}/{uuid.uuid4().hex}"
        rows.write.mode("append").parquet(t.path)

    def _replace(self, t: Table, rows: DataFrame) -> None:
        """New rows in a new folder, so that readers of the old one are not disturbed."""
        if self.root:
            path = f"{self.root}/{uuid.uuid4().hex}"
            rows.write.parquet(path)
            t.path, t.frame, t.external = path, None, []
        else:
            t.frame, t.path, t.external = rows, None, []

    # ---- queries

    def sql(self, text: str, parameters: Sequence = ()) -> DataFrame | None:
        """Runs a statement; a query gives its result, other statements what they show or None."""
        p = Parser(text)
        word = p.peek().word()
        if word in ("SELECT", "WITH") or p.peek().value == "(":
            return self._select(text, parameters)
        handler: Callable | None = getattr(self, f"_{word.lower()}", None) if word.isalpha() else None
        if word not in _STATEMENTS or handler is None:
            raise SqlError(f"no statement {word or p.peek().value!r}")
        p.next()
        return handler(p, text)

    def _select(self, text: str, parameters: Sequence = ()) -> DataFrame | None:
        p = Parser(text)
        at = next((i for i, t in enumerate(p.tokens) if t.word() == "INTO" and p.tokens[i + 1].word() == "OUTFILE"), None)
        if at is None:
            return self._query(text, parameters)
        end = p.tokens[at].at
        p.at = at
        p.need("INTO", "OUTFILE")
        path = str(p.next().value)
        write(self._query(text[:end], parameters), path, Options.of(self._options(p)))
        return None

    def _query(self, text: str, parameters: Sequence = ()) -> DataFrame:
        """A query over all rows or, with ``execute_mode='request'`` and ``values`` in its CONFIG, for request rows of its first table."""
        query = parse_query(text)
        config = getattr(query, "config", {})
        mode = str(config["execute_mode"].value).lower() if "execute_mode" in config else ""
        if mode not in ("", "offline", "online", "request"):
            raise SqlError(f"no execute_mode {mode}")
        if (mode == "request") != ("values" in config):
            raise SqlError("a request takes execute_mode='request' and values")
        if mode != "request":
            return Compiler(self.spark, self.table, parameters).query(query, {})
        values = config["values"]
        rows = values.args if getattr(values, "name", "") == "array" else [values]
        rows = [r.args if getattr(r, "name", "") == "struct" else [r] for r in rows]
        schema = self.find(_first_table(query)).schema
        return RequestCompiler(self.spark, self.table, self._rows(schema, schema.names, rows, {})).query(query, {})

    def _rows(self, schema: T.StructType, columns: Sequence[str], rows: Sequence[Sequence], defaults: dict) -> DataFrame:
        """Rows of expressions as a table: literals go into it as they are, in one plan however many there are; other expressions are computed."""
        where = {c.lower(): i for i, c in enumerate(columns)}
        if any(len(r) != len(columns) for r in rows):
            raise SqlError("as many values as columns are needed")
        cells = [[r[where[f.name.lower()]] if f.name.lower() in where else Literal(defaults.get(f.name)) for f in schema] for r in rows]
        plain = [all(isinstance(c, Literal) and not c.kind for c in r) for r in cells]
        parts = []
        if any(plain):
            text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
            values = [tuple(None if c.value is None else str(c.value).lower() if isinstance(c.value, bool) else str(c.value) for c in r) for r, p in zip(cells, plain) if p]
            parts.append(self.spark.createDataFrame(values, text).select(*[_converted(_number(F.col(f"`{f.name}`"), f.dataType), f.dataType).alias(f.name) for f in schema]))
        compiler, one = Compiler(self.spark, self.table), self.spark.range(1)
        for r in (r for r, p in zip(cells, plain) if not p):
            parts.append(one.select(*[_converted(compiler.value(c, Scope(one)), f.dataType).alias(f.name) for c, f in zip(r, schema)]))
        return reduce(DataFrame.unionByName, parts)

    def _options(self, p: Parser) -> dict:
        out: dict = {}
        if p.take("OPTIONS"):
            p.need("(")
            while not p.take(")"):
                key = p.identifier().lower()
                p.need("=")
                value = p.expression()
                out[key] = value.value if isinstance(value, Literal) else ".".join(getattr(value, "parts", ())) or value
                p.take(",")
        return out

    def _rest(self, p: Parser, text: str) -> str:
        return text[p.peek().at :]

    # ---- definitions

    def _create(self, p: Parser, text: str):
        if p.take("DATABASE"):
            given = p.take("IF", "NOT", "EXISTS")
            name = p.identifier().lower()
            if name in self.databases and not given:
                raise SqlError(f"database {name} exists")
            self.databases.setdefault(name, {})
        elif p.take("INDEX"):
            name = p.identifier()
            p.need("ON")
            table = self.find(p.name())
            p.need("(")
            keys = self._names(p)
            table.indexes.append(Index(keys, name=name, **self._retention(self._options(p))))
        elif p.take("TABLE"):
            self._create_table(p)
        elif p.take("PROCEDURE"):
            self._create_procedure(p, text)
        elif p.peek().word() in ("FUNCTION", "AGGREGATE"):
            self._create_function(p)
        else:
            raise SqlError("CREATE what?")

    def _create_procedure(self, p: Parser, text: str) -> None:
        """``CREATE PROCEDURE name(column type, ...) BEGIN SELECT ...; END``: a query for request rows of these columns."""
        name = p.name()[-1].lower()
        if name in self.deployments:
            raise SqlError(f"procedure {name} exists")
        p.need("(")
        schema = T.StructType()
        while not p.take(")"):
            p.take("CONST")
            column, kind = p.identifier(), p.type_name()
            schema = schema.add(column, T._parse_datatype_string(kind))
            p.take(",")
        p.need("BEGIN")
        begin = p.peek().at
        ends = [t for t in p.tokens if t.word() == "END" and t.at > begin]
        if not ends:
            raise SqlError("END expected")
        query = text[begin : ends[-1].at].strip().rstrip(";")
        first = self.find(_first_table(parse_query(query))).schema
        if [f.dataType for f in first] != [f.dataType for f in schema]:
            raise SqlError("a procedure takes the columns of its query's first table")
        self.deployments[name], self.procedures[name] = query, first

    def _create_function(self, p: Parser) -> None:
        """``CREATE [AGGREGATE] FUNCTION f(types) RETURNS type OPTIONS (FILE='f.py')``: functions of a Python file.

        A function of that name in the file takes and gives pandas series. An aggregate has ``f_init()``, ``f_update(state, value)``, ``f_merge(state,
        state)``, which may be missing, and ``f_output(state)``; known values come oldest first.
        """
        whole = p.take("AGGREGATE")
        p.need("FUNCTION")
        name = p.name()[-1].lower()
        p.need("(")
        kinds = []
        while not p.take(")"):
            kinds.append(p.type_name())
            p.take(",")
        p.need("RETURNS")
        kind = p.type_name()
        given = self._options(p)
        if unknown := sorted(set(given) - {"file", "arg_nullable", "return_nullable"}):
            raise SqlError(f"options {unknown} aren't served")
        if name in scalar.REGISTRY or name in aggregates.REGISTRY:
            raise SqlError(f"function {name} exists")
        make = own.aggregate if whole else own.function
        (aggregates.REGISTRY if whole else scalar.REGISTRY)[name] = make(str(given["file"]), name, kinds, kind)
        self.functions[name] = f"{'aggregate ' if whole else ''}{name}({', '.join(kinds)}) {kind}"

    def _names(self, p: Parser) -> list[str]:
        out = [p.identifier()]
        while p.take(","):
            out.append(p.identifier())
        p.need(")")
        return out

    def _retention(self, given: dict) -> dict:
        ttl = given.get("ttl", 0)
        kind = str(given.get("ttl_type", "absolute")).lower()
        minutes = lambda v: int(str(v)[:-1]) * {"m": 1, "h": 60, "d": 1440}[str(v)[-1]] if str(v)[-1] in "mhd" else int(v)
        pair = ttl if isinstance(ttl, tuple) else (ttl, 0)
        rows = int(pair[1] or (pair[0] if kind == "latest" else 0))
        return {"time": given.get("ts"), "ttl_kind": kind, "ttl": 0 if kind == "latest" else minutes(pair[0]), "ttl_rows": rows}

    def _create_table(self, p: Parser) -> None:
        given = p.take("IF", "NOT", "EXISTS")
        name = p.name()
        database = self.databases[name[-2].lower() if len(name) > 1 else self.current]
        if name[-1].lower() in database:
            if given:
                return
            raise SqlError(f"table {name[-1]} exists")
        if p.take("LIKE"):
            kind = p.identifier().lower()
            path = str(p.next().value)
            found = read(self.spark, path, Options(format=kind))
            database[name[-1].lower()] = Table(found.schema)
            return
        p.need("(")
        t = Table(T.StructType())
        while not p.take(")"):
            if p.take("INDEX", "("):
                more: dict = {}
                while not p.take(")"):
                    key = p.identifier().lower()
                    p.need("=")
                    if key == "key" and p.take("("):
                        more[key] = self._names(p)
                    elif p.take("("):
                        pair = [p.next().value, p.take(",") and p.next().value]
                        more[key] = tuple(x[0] if isinstance(x, tuple) else x for x in pair)
                        p.need(")")
                    else:
                        v = p.next()
                        more[key] = v.value[0] if v.kind == "int" else v.value
                    p.take(",")
                keys = more.pop("key")
                t.indexes.append(Index(keys if isinstance(keys, list) else [keys], **self._retention(more)))
            else:
                column, kind = p.identifier(), p.type_name()
                t.schema = t.schema.add(column, T._parse_datatype_string(kind))
                while True:
                    if p.take("NOT", "NULL"):
                        t.required.append(column)
                    elif p.take("DEFAULT"):
                        t.defaults[column] = p.expression().value
                    elif not p.take("NULL"):
                        break
            p.take(",")
        self._options(p)
        database[name[-1].lower()] = t

    def _drop(self, p: Parser, text: str):
        kind = p.next().word()
        if kind == "AGGREGATE":
            kind = p.next().word()
        given = p.take("IF", "EXISTS")
        name = p.name()
        if kind == "DATABASE":
            self.databases.pop(name[0].lower(), None)
        elif kind == "FUNCTION":
            if self.functions.pop(name[-1].lower(), None) is None and not given:
                raise SqlError(f"no function {name[-1]}")
            for registry in (scalar.REGISTRY, aggregates.REGISTRY):
                registry.pop(name[-1].lower(), None)
        elif kind in ("DEPLOYMENT", "PROCEDURE"):
            self.deployments.pop(name[-1].lower(), None)
            self.procedures.pop(name[-1].lower(), None)
            self.long_windows.pop(name[-1].lower(), None)
        elif kind == "INDEX":
            t = self.find(name[:-1])
            t.indexes = [i for i in t.indexes if i.name != name[-1]]
        elif kind == "TABLE":
            database = self.databases[name[-2].lower() if len(name) > 1 else self.current]
            if database.pop(name[-1].lower(), None) is None and not given:
                raise SqlError(f"no table {name[-1]}")
        else:
            raise SqlError(f"DROP {kind}?")

    def _alter(self, p: Parser, text: str):
        p.need("TABLE")
        t = self.find(p.name())
        while p.peek().kind != "end" and not p.take(";"):
            adding = p.next().word() == "ADD"
            p.need("OFFLINE_PATH")
            path = str(p.next().value)
            t.external = [*t.external, path] if adding else [x for x in t.external if x != path]
            p.take(",")

    def _use(self, p: Parser, text: str):
        name = p.identifier().lower()
        if name not in self.databases:
            raise SqlError(f"no database {name}")
        self.current = name

    def _set(self, p: Parser, text: str):
        while p.take("@"):
            pass
        name = p.name()[-1].lower()
        p.need("=")
        self.variables[name] = p.expression().value

    # ---- rows

    def _insert(self, p: Parser, text: str):
        absent = p.take("OR", "IGNORE")
        p.need("INTO")
        p.take("TABLE")
        name = p.name()
        t = self.find(name)
        columns = t.schema.names
        if p.take("("):
            columns = self._names(p)
        p.need("VALUES")
        rows = []
        while True:
            p.need("(")
            values = []
            while not p.take(")"):
                values.append(p.expression())
                p.take(",")
            rows.append(values)
            if not p.take(","):
                break
        out = self._rows(t.schema, columns, rows, t.defaults)
        if t.required:
            held = out.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(t.required)]).first()
            if missing := [c for c, n in zip(t.required, held) if n]:
                raise SqlError(f"columns {missing} may not be NULL")
        self._append(t, out, absent, name)

    def _load(self, p: Parser, text: str):
        p.need("DATA", "INFILE")
        path = str(p.next().value)
        p.need("INTO", "TABLE")
        name = p.name()
        t, given = self.find(name), Options.of(self._options(p))
        if not given.deep_copy:
            t.external = [*([] if given.mode == "overwrite" else t.external), path]
            return
        rows = compile_query(self.spark, given.sql, lambda n: read(self.spark, path, given)) if given.sql else read(self.spark, path, given, t.schema)
        if t.indexes and self.root:
            # in ranges of the first index's keys and time, so that a scan for some keys skips files and row groups; a hot key is split by its time
            by = [*t.indexes[0].keys, *([t.indexes[0].time] if t.indexes[0].time else [])]
            rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
        held = t.path or t.frame is not None or t.external
        if given.mode == "error_if_exists" and held:
            raise SqlError(f"table {name[-1]} has rows")
        if given.mode == "overwrite":
            self._replace(t, rows)
        else:
            self._append(t, rows, given.put_if_absent, name)

    def _delete(self, p: Parser, text: str):
        p.need("FROM")
        name = p.name()
        t = self.find(name)
        p.need("WHERE")
        df = self.table(name)
        cond = Compiler(self.spark, self.table).value(p.expression(), Scope(df, {name[-1].lower(): {c.lower(): c for c in df.columns}}))
        self._replace(t, df.filter(~F.coalesce(cond, F.lit(False))))

    def _truncate(self, p: Parser, text: str):
        p.need("TABLE")
        t = self.find(p.name())
        t.path, t.frame, t.external = None, None, []

    # ---- deployed queries

    def _deploy(self, p: Parser, text: str):
        given = p.take("IF", "NOT", "EXISTS")
        name = p.identifier().lower()
        options = self._options(p)
        if unknown := sorted(set(options) - {"long_windows", "skip_index_check", "sync", "range_bias", "rows_bias"}):
            raise SqlError(f"options {unknown} aren't served")
        query = self._rest(p, text)
        long = _long_windows(options.get("long_windows"), parse_query(query))
        if name in self.deployments:
            if not given:
                raise SqlError(f"deployment {name} exists")
            return
        self.deployments[name], self.long_windows[name] = query, long

    def request(self, name: str, rows: DataFrame) -> DataFrame:
        """Answers of a deployed query for request rows of its first table, each as if it alone were inserted.

        Long windows are answered from buckets, which are built for the batch from the table as it is then.
        """
        query = parse_query(self.deployments[name.lower()])
        return RequestCompiler(self.spark, self.table, rows, self.long_windows.get(name.lower())).query(query, {})

    def _call(self, p: Parser, text: str):
        """``CALL name(values)``: a deployment or procedure for one request row."""
        name = p.name()[-1].lower()
        p.need("(")
        values = []
        while not p.take(")"):
            values.append(p.expression())
            p.take(",")
        if name not in self.deployments:
            raise SqlError(f"no deployment or procedure {name}")
        schema = self.procedures.get(name) or self.find(_first_table(parse_query(self.deployments[name]))).schema
        return self.request(name, self._rows(schema, schema.names, [values], {}))

    # ---- looking

    def _show(self, p: Parser, text: str):
        what = p.next().word()
        if what in ("DEPLOYMENT", "PROCEDURE") or what == "CREATE" and p.take("PROCEDURE"):
            name = p.name()[-1].lower()
            if name not in self.deployments:
                raise SqlError(f"no deployment or procedure {name}")
            query = self.deployments[name]
            inputs = self.find(_first_table(parse_query(query))).schema
            outputs = self.request(name, self.spark.createDataFrame([], inputs)).schema
            rows = [(name, query, *(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x) for x in (inputs, outputs)))]
            return self.spark.createDataFrame(rows, "name string, query string, inputs string, outputs string")
        if what == "CREATE":
            p.need("TABLE")
            name = p.name()
            return self.spark.createDataFrame([(name[-1], self._definition(name[-1], self.find(name)))], "table string, statement string")
        if what == "TABLE":
            p.need("STATUS")
            rows = [(database, name, t.path or "", len(t.external), len(t.indexes), self.table((database, name)).count()) for database, ts in sorted(self.databases.items()) for name, t in sorted(ts.items())]
            return self.spark.createDataFrame(rows, "database string, name string, path string, external_files int, indexes int, rows bigint")
        rows = {
            "DATABASES": lambda: sorted(self.databases), "TABLES": lambda: sorted(self.databases[self.current]), "DEPLOYMENTS": lambda: sorted(self.deployments), "PROCEDURES": lambda: sorted(self.procedures),
            "VARIABLES": lambda: [f"{k}={v}" for k, v in sorted(self.variables.items())], "FUNCTIONS": lambda: sorted({*scalar.REGISTRY, *self.functions}),
        }
        if what not in rows:
            raise SqlError(f"SHOW {what}?")
        return self.spark.createDataFrame([(x,) for x in rows[what]()], "name string")

    def _definition(self, name: str, t: Table) -> str:
        """The statement that makes a table like this one."""
        literal = lambda v: "'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else str(v).lower()
        parts = [f"`{f.name}` {f.dataType.simpleString()}" + (" NOT NULL" if f.name in t.required else "") + (f" DEFAULT {literal(t.defaults[f.name])}" if f.name in t.defaults else "") for f in t.schema]
        for i in t.indexes:
            ttl = {"absolute": f"{i.ttl}m", "latest": str(i.ttl_rows)}.get(i.ttl_kind, f"({i.ttl}m, {i.ttl_rows})")
            kept = f", TTL_TYPE={i.ttl_kind}, TTL={ttl}" if i.ttl or i.ttl_rows else ""
            parts.append(f"INDEX(KEY=({', '.join(f'`{k}`' for k in i.keys)})" + (f", TS=`{i.time}`" if i.time else "") + kept + ")")
        return f"CREATE TABLE `{name}` (\n" + ",\n".join(f"  {x}" for x in parts) + "\n)"

    def _desc(self, p: Parser, text: str):
        t = self.find(p.name())
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString(), f.name not in t.required) for f in t.schema], "field string, type string, nullable boolean")

    _describe = _desc

    def _explain(self, p: Parser, text: str):
        df = compile_query(self.spark, self._rest(p, text), self.table)
        return self.spark.createDataFrame([(df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")),)], "plan string")

    # ---- functions

    def register_function(self, name: str, f: Callable[..., Column]) -> None:
        """Makes a function of columns (a built-in expression or a pandas UDF) a function of the dialect."""
        scalar.REGISTRY[name.lower()] = f

    def register_aggregate(self, name: str, zero: Column, update: Callable, output: Callable | None = None) -> None:
        """Makes an aggregate of a start value, an update and an output, all over columns; rows come newest first, NULL is skipped."""
        def run(s, x: Column) -> Column:
            return F.aggregate(F.reverse(s.list(x)), zero, update, *([output] if output else []))

        aggregates.REGISTRY[name.lower()] = run


class RequestCompiler(Compiler):
    """Compiles a query for request rows: the first table is the requests, and windows see its history.

    A select that has windows is compiled twice up to them: for the requests, and for the history that their windows see. So a window over joined tables
    or over a subquery sees each history row with the joins and columns that the request row has.
    """

    def __init__(self, spark: SparkSession, tables, rows: DataFrame, long_windows: dict[str, int] | None = None):
        super().__init__(spark, tables)
        self.rows, self.history = rows, None
        self.long_windows = long_windows or {}
        self.past: DataFrame | None = None  # the history of the select at hand
        self.plain = False  # whether all rows are meant

    def table(self, source, env, number):
        alias, df, columns = super().table(source, env, number)
        if number == 0 and isinstance(source.query, tuple) and self.history is None and not self.plain:
            self.history = df
            df = self.rows.select(*columns).toDF(*df.columns)
        return alias, df, columns

    def frame(self, spec, scope, env):
        f = super().frame(spec, scope, env)
        return f if self.plain else request_frame(scope.df, self.past.select(*scope.df.columns), f)

    def windowed(self, q, scope, calls, done, env):
        if self.plain:
            return super().windowed(q, scope, calls, done, env)
        self.plain = True
        self.past = self.sources(q, env).df
        self.plain = False
        parts: dict[tuple, list] = {}
        for c in calls:
            if self.from_buckets(c, q, scope, env):
                base = c.name.removesuffix("_where")
                parts.setdefault((str(c.window).lower(), c.args, c.name != base, self.together(c, base, scope)), []).append(c)
        long = {c for cs in parts.values() for c in cs}
        rest = [c for c in calls if c not in long]
        df = super().windowed(q, scope, rest, done, env) if rest else scope.df
        for n, ((window, *_), cs) in enumerate(parts.items()):
            df = self.bucketed(df, scope, super().frame(q.windows[window], scope, env), self.long_windows[window], cs, n, done)
        return df

    def from_buckets(self, c, q, scope: Scope, env) -> bool:
        """Whether an aggregate is over a long window, and one that totals of buckets can answer."""
        spec = None if isinstance(c.window, WindowSpec) else q.windows.get(str(c.window).lower())
        if spec is None or str(c.window).lower() not in self.long_windows or q.joins or not isinstance(q.source.query, tuple) or self.history.columns != scope.df.columns:
            return False
        if spec.kind != "rows_range" or spec.order_by is None or spec.unions or spec.maxsize is not None or spec.exclude_current_time or not spec.partition_by or spec.start.offset is None:
            return False
        base = c.name.removesuffix("_where")
        if base not in ("count", "sum", "avg", "min", "max") or len(c.args) != 1 + (c.name != base) or any(_calls(a) for a in c.args):
            return False
        f = super().frame(spec, scope, env)
        if f.start - f.start_open < f.end + f.end_open:
            return False
        return base == "count" or not isinstance(c.args[0], Star) and self.type_of(self.value(c.args[0], scope), scope) in _NUMBERS

    def together(self, c, base: str, scope: Scope) -> str:
        """Which aggregates of one argument share their buckets: all, where the sum of its values as they are can't leave its type."""
        if isinstance(c.args[0], Star):
            return base
        kind = self.type_of(self.value(c.args[0], scope), scope)
        return "all" if kind in _NUMBERS - {"bigint"} else "range" if base in ("min", "max") else base

    def bucketed(self, df: DataFrame, scope: Scope, f, bucket_ms: int, calls: list, number: int, done: dict) -> DataFrame:
        """Rows of ``df`` with aggregates of one argument over a long window: the history's from buckets, and the row's own value."""
        base = calls[0].name.removesuffix("_where")
        value = F.lit(1) if isinstance(calls[0].args[0], Star) else self.value(calls[0].args[0], scope)
        kind = self.type_of(value, scope)
        if kind in _NUMBERS - {"bigint"} and not isinstance(calls[0].args[0], Star):
            value = value.cast("double" if kind in ("float", "double") else "bigint")
        elif base == "count":
            value = F.when(value.isNotNull(), F.lit(1))
        elif base == "avg" or base == "sum":
            value = value.cast("double" if base == "avg" or kind in ("float", "double") else "bigint")
        elif kind == "bigint":
            value = value.cast("decimal(20,0)")  # so that the buckets' sums, which nobody asks for, can't overflow
        if len(calls[0].args) > 1:
            value = F.when(self.value(calls[0].args[1], scope), value)
        at, end = millis(scope.df, f.order_by), f.end + f.end_open
        keys = F.struct(*f.partition_by)  # equal where NULL keys are
        history = self.history.select(keys.alias("__keys"), at.alias("__when"), value.alias("__value")).filter("__when >= 0")
        own = F.lit(None).cast(history.schema["__value"].dataType) if end or f.exclude_current_row else value
        asked = df.filter(at >= 0).withColumns({"__keys": keys, "__when": at - F.lit(end).cast("long"), "__own": own})
        buckets = build_buckets(history, ["__keys"], "__when", F.col("__value"), bucket_ms)
        out = long_window(asked, history, buckets, ["__keys"], "__when", F.col("__value"), f.start - f.start_open - end, bucket_ms)
        mine, none = F.col("__own"), F.col("sum").isNull() & F.col("__own").isNull()
        count = F.col("count") + F.when(mine.isNull(), F.lit(0)).otherwise(F.lit(1))
        total = F.when(~none, F.coalesce(F.col("sum"), F.lit(0)) + F.coalesce(mine, F.lit(0)))
        found = {"count": lambda: count, "sum": lambda: wrapped(total, kind), "avg": lambda: total / F.nullif(count, F.lit(0)), "min": lambda: F.least("min", mine).cast(kind), "max": lambda: F.greatest("max", mine).cast(kind)}
        shown = []
        for n, c in enumerate(calls):
            shown.append(found[c.name.removesuffix("_where")]().alias(f"l_{number}_{n}"))
            done[c] = F.col(f"l_{number}_{n}")
        return out.select(*df.columns, *shown)


def _long_windows(given: str | None, query) -> dict[str, int]:
    """Windows of the option LONG_WINDOWS with the ms of their buckets, a day where none is given. Sizes in rows are left out."""
    out = {}
    for part in str(given).split(",") if given else ():
        window, _, size = (x.strip().lower() for x in part.partition(":"))
        if isinstance(query, Select) and window not in query.windows:
            raise SqlError(f"no window {window}")
        if size and not (size[:-1] if size[-1] in "smhd" else size).isdigit() or size and int(size.rstrip("smhd")) < 1:
            raise SqlError(f"no size of a bucket: {size}")
        if not size.isdigit():
            out[window] = interval_ms(size or "1d")
    return out


def _first_table(query) -> tuple[str, ...]:
    """The name of the table that a query reads first, whose rows requests are."""
    while not isinstance(query, tuple):
        query = query.query if isinstance(query, With) else query.parts[0] if isinstance(query, SetOp) else query.source.query
    return query


def _number(text: Column, kind: T.DataType) -> Column:
    """A literal written as text; for a time a whole number is milliseconds."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.date_format(F.timestamp_millis(text.try_cast("bigint")), "yyyy-MM-dd HH:mm:ss.SSS"), text)
    return text


def _converted(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return scalar.timestamp(c).cast(kind)
    return c.cast("string").try_cast(kind) if not isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else c.cast(kind)


_NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}
_STATEMENTS = set("CREATE DROP ALTER USE SET INSERT LOAD DELETE TRUNCATE DEPLOY CALL SHOW DESC DESCRIBE EXPLAIN".split())
