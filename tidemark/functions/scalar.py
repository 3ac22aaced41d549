"""Scalar functions of the dialect, as expressions over Spark's built-ins.

Unless a docstring says otherwise a NULL argument gives NULL. Strings are measured in bytes only where that is
said. Dates and times follow the session's time zone.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: name in lower case -> function of columns (and literal Python values where a docstring says so)
REGISTRY: dict[str, Callable[..., Column]] = {}


def scalar(*names: str):
    def add(f):
        for n in names or (f.__name__.rstrip("_"),):
            REGISTRY[n] = f
        return f

    return add


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _any_null(*xs: Column) -> Column:
    return reduce(Column.__or__, (x.isNull() for x in xs))


# ---- strings


@scalar("concat")
def concat(*xs) -> Column:
    return F.concat(*[col(x).cast("string") for x in xs])


@scalar("concat_ws")
def concat_ws(sep, *xs) -> Column:
    """Unlike Spark's, NULL if any argument is NULL."""
    xs = [col(x).cast("string") for x in xs]
    parts = [p for i, x in enumerate(xs) for p in ((col(sep), x) if i else (x,))]
    return F.when(col(sep).isNotNull(), F.concat(*parts))


@scalar("substring", "substr")
def substring(s, pos, length=None) -> Column:
    """From 1; negative positions count from the end. Position 0 or outside, or length < 1, gives ""."""
    s, pos = col(s), col(pos).cast("int")
    size = F.length(s)
    begin = F.when(pos > 0, pos).otherwise(size + pos + 1)
    outside = (pos == 0) | (F.abs(pos) > size)
    taken = F.substring(s, begin, size) if length is None else F.substring(s, begin, col(length).cast("int"))
    if length is not None:
        outside = outside | (col(length) < 1)
    return F.when(_any_null(s, pos, *([] if length is None else [col(length)])), None).when(outside, "").otherwise(taken)


@scalar("locate")
def locate(sub, s, pos=1) -> Column:
    """First place at or after ``pos``; 0 if none or ``pos`` < 1; an empty string is found at ``pos`` itself."""
    sub, s, pos = col(sub), col(s), col(pos).cast("int")
    found = F.call_function("locate", sub, s, pos)
    empty = F.when(pos <= F.length(s) + 1, pos).otherwise(0)
    return F.when(_any_null(sub, s, pos), None).when(pos < 1, 0).when(sub == "", empty).otherwise(found)


@scalar("strcmp")
def strcmp(a, b) -> Column:
    a, b = col(a), col(b)
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


@scalar("ucase", "upper")
def upper(s) -> Column:
    return F.upper(col(s))


@scalar("lcase", "lower")
def lower(s) -> Column:
    return F.lower(col(s))


@scalar("reverse")
def reverse(s) -> Column:
    return F.reverse(col(s))


@scalar("char")
def char(n) -> Column:
    return F.call_function("char", F.pmod(col(n).cast("long"), F.lit(256)))


@scalar("char_length", "character_length")
def char_length(s) -> Column:
    """Length in bytes."""
    return F.octet_length(col(s).cast("string"))


@scalar("replace")
def replace(s, search, by="") -> Column:
    return F.replace(col(s), col(search), col(by))


@scalar("hex")
def hex_(x) -> Column:
    """Of a number (rounded to an integer first) or of a string's bytes."""
    x = col(x)
    number = F.when(F.typeof(x).isin("float", "double"), F.hex(F.round(x.cast("double")).cast("long")))
    whole = F.when(F.typeof(x).isin("tinyint", "smallint", "int", "bigint"), F.hex(x.cast("long")))
    return F.coalesce(number, whole, F.when(F.typeof(x) == "string", F.hex(x.cast("string"))))


@scalar("unhex")
def unhex(s) -> Column:
    return F.unhex(col(s)).cast("string")


@scalar("string")
def string(x) -> Column:
    return col(x).cast("string")


def fixed(x: Column, kind: str) -> Column:
    """A value as text in encoded results: floating numbers with six decimals."""
    return F.format_string("%f", x.cast("double")) if kind in ("float", "double") else x.cast("string")


def _like(s, pattern, escape, ignore_case: bool) -> Column:
    s, pattern = col(s), col(pattern)
    if escape == "":
        pattern, escape = F.replace(pattern, F.lit("\\"), F.lit("\\\\")), "\\"
    return (F.ilike if ignore_case else F.like)(s, pattern, F.lit(escape))


@scalar("like_match")
def like_match(s, pattern, escape="\\") -> Column:
    """``%`` and ``_``; ``escape`` is a literal, "" turns escaping off."""
    return _like(s, pattern, escape, False)


@scalar("ilike_match")
def ilike_match(s, pattern, escape="\\") -> Column:
    return _like(s, pattern, escape, True)


@scalar("regexp_like", "rlike")
def regexp_like(s, pattern, flags="") -> Column:
    """The whole string must match; literal ``flags`` among c, i, m, s (others are ignored, the last of c and i holds). A literal pattern that is no expression gives NULL."""
    marks = "".join(m for m in "ms" if m in flags) + ("i" if flags.rfind("i") > flags.rfind("c") else "")
    head = f"(?{marks})" if marks else ""
    if isinstance(pattern, str):
        try:
            re.compile(pattern)
        except re.error:
            return F.lit(None).cast("boolean")
        return col(s).rlike(f"^{head}(?:{pattern})$")
    return F.call_function("rlike", col(s), F.concat(F.lit(f"^{head}(?:"), col(pattern), F.lit(")$")))


def _quoted(d: str) -> str:
    return re.escape(d) if len(d) == 1 else d


@scalar("split_array")
def split_array(s, d) -> Column:
    return F.split(col(s), re.escape(d))


@scalar("split")
def split(s, d) -> Column:
    """A delimiter of one character is taken literally, a longer one as a regular expression."""
    return F.split(col(s), _quoted(d))


def _pairs(s, d: str, kv: str, take: int) -> Column:
    parts = F.transform(F.split(col(s), _quoted(d)), lambda p: F.split(p, re.escape(kv), 2))
    return F.transform(F.filter(parts, lambda p: F.size(p) == 2), lambda p: p[take])


@scalar("split_by_key")
def split_by_key(s, d, kv) -> Column:
    """Keys of "k:v" parts; parts without the inner delimiter are left out."""
    return _pairs(s, d, kv, 0)


@scalar("split_by_value")
def split_by_value(s, d, kv) -> Column:
    return _pairs(s, d, kv, 1)


@scalar("join")
def join(xs, sep) -> Column:
    return F.array_join(col(xs), sep)


@scalar("size")
def size(xs) -> Column:
    return F.size(col(xs))


def _except(xs, dropped, take: int) -> Column:
    gone = F.split(col(dropped), ",")
    return F.filter(col(xs), lambda p: ~F.coalesce(F.array_contains(gone, F.split(p, ":", 2)[take]), F.lit(False)))


@scalar("list_except_by_key")
def list_except_by_key(xs, dropped) -> Column:
    """The "k:v" items whose key isn't in the comma list."""
    return _except(xs, dropped, 0)


@scalar("list_except_by_value")
def list_except_by_value(xs, dropped) -> Column:
    return F.filter(col(xs), lambda p: ~F.coalesce(F.array_contains(F.split(col(dropped), ","), F.try_element_at(F.split(p, ":", 2), F.lit(2))), F.lit(False)))


# ---- numbers


@scalar("log")
def log(a, b=None) -> Column:
    return F.ln(col(a)) if b is None else F.ln(col(b)) / F.ln(col(a))


for _n in ("ln", "log2", "log10", "exp", "sqrt", "degrees", "radians", "acos", "asin", "cos", "sin", "tan"):
    REGISTRY[_n] = (lambda f: lambda x: f(col(x).cast("double")))(getattr(F, _n))


@scalar("cot")
def cot(x) -> Column:
    return F.lit(1.0) / F.tan(col(x).cast("double"))


@scalar("atan")
def atan(y, x=None) -> Column:
    return F.atan(col(y).cast("double")) if x is None else F.atan2(col(y).cast("double"), col(x).cast("double"))


@scalar("atan2")
def atan2(y, x) -> Column:
    return F.atan2(col(y).cast("double"), col(x).cast("double"))


@scalar("abs")
def abs_(x) -> Column:
    return F.abs(col(x))


@scalar("ceil", "ceiling")
def ceil(x) -> Column:
    return F.ceil(col(x))


@scalar("floor")
def floor(x) -> Column:
    return F.floor(col(x))


@scalar("pow", "power")
def power(a, b) -> Column:
    return F.pow(col(a), col(b))


@scalar("round")
def round_(x, digits=0) -> Column:
    """Half up, keeps the type of ``x``."""
    return F.call_function("round", col(x), F.lit(digits))


@scalar("truncate")
def truncate(x) -> Column:
    x = col(x)
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))


@scalar("pmod")
def pmod(a, b) -> Column:
    """As Spark's; NULL for b = 0."""
    return F.pmod(col(a), F.nullif(col(b), F.lit(0)))


@scalar("inc")
def inc(x) -> Column:
    return col(x) + 1


@scalar("add")
def add(a, b) -> Column:
    return col(a) + col(b)


@scalar("identity")
def identity(x) -> Column:
    return col(x)


@scalar("minimum")
def minimum(a, b) -> Column:
    a, b = col(a), col(b)
    return F.when(a <= b, a).when(a > b, b)


@scalar("maximum")
def maximum(a, b) -> Column:
    a, b = col(a), col(b)
    return F.when(a >= b, a).when(a < b, b)


@scalar("make_tuple")
def make_tuple(*xs) -> Column:
    return F.struct(*[col(x).alias(f"_{i + 1}") for i, x in enumerate(xs)])


#: Fixed value: radius of the earth in km.
EARTH_KM = 6372.8


@scalar("earth_distance")
def earth_distance(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km."""
    a, b, c, d = (F.radians(col(x).cast("double")) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(h))


def divide(a, b) -> Column:
    """``/``: always double; by zero infinite, or not a number for 0/0."""
    a, b = col(a).cast("double"), col(b).cast("double")
    zero = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def integer_divide(a, b) -> Column:
    """``DIV``; NULL for a zero divisor."""
    return F.call_function("div", col(a), F.nullif(col(b), F.lit(0)))


def remainder(a, b) -> Column:
    return F.try_mod(col(a), col(b))


def xor(a, b) -> Column:
    return col(a) != col(b)


# ---- dates and times

for _n in ("year", "month", "dayofweek", "dayofyear", "weekofyear", "hour", "minute", "second", "last_day"):
    REGISTRY[_n] = (lambda f: lambda x: f(_time(x)))(getattr(F, _n))
REGISTRY["week"] = REGISTRY["weekofyear"]


def _time(x) -> Column:
    """A date or timestamp as it is, an integer as milliseconds."""
    return col(x)


@scalar("day", "dayofmonth")
def day(x) -> Column:
    return F.dayofmonth(col(x))


#: Letters of strftime and what they are in Spark's patterns.
STRFTIME = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "e": "d"}


@scalar("date_format")
def date_format(x, pattern) -> Column:
    """Literal ``pattern`` in strftime's letters."""
    out = ""
    for m in re.finditer(r"%(.)|([^%]+)|%", pattern, re.S):
        if m.group(1) == "%":
            out += "%"
        elif m.group(1):
            out += STRFTIME[m.group(1)]
        elif m.group(2):
            out += re.sub(r"[A-Za-z']+", lambda t: "'" + t.group().replace("'", "''") + "'", m.group(2))
    return F.date_format(col(x), out)


@scalar("date")
def date(x) -> Column:
    """Of a timestamp or a string; NULL if it isn't one."""
    return _try(col(x), "date")


def _try(x: Column, kind: str) -> Column:
    return x.try_cast(kind)


@scalar("timestamp")
def timestamp(x) -> Column:
    """Of milliseconds, a date or a string."""
    x = col(x)
    number = F.when(F.typeof(x).isin("tinyint", "smallint", "int", "bigint"), F.timestamp_millis(x.cast("string").try_cast("bigint")))
    return F.coalesce(number, F.when(~F.typeof(x).isin("tinyint", "smallint", "int", "bigint"), x.cast("string").try_cast("timestamp")))


@scalar("datediff")
def datediff(a, b) -> Column:
    return F.datediff(_try(col(a), "date"), _try(col(b), "date"))


@scalar("unix_timestamp")
def unix_timestamp(x=None) -> Column:
    """Seconds; of nothing, NULL or "" the present time."""
    if x is None:
        return F.unix_timestamp()
    text = col(x).cast("string")
    return F.when(text.isNull() | (text == ""), F.unix_timestamp()).otherwise(F.unix_seconds(text.try_cast("timestamp")))


@scalar("add_months")
def add_months(d, n) -> Column:
    return F.add_months(col(d), col(n).cast("int"))


# ---- casts, NULL, conditions

#: Strings that are true or false.
TRUE, FALSE = ("y", "yes", "1", "t", "true"), ("n", "no", "0", "f", "false")


@scalar("bool")
def bool_(x) -> Column:
    text = F.lower(col(x).cast("string"))
    return F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False)


for _n, _t in {"double": "double", "float": "float", "int": "int", "int32": "int", "bigint": "bigint", "int64": "bigint", "smallint": "smallint", "int16": "smallint"}.items():
    REGISTRY[_n] = (lambda t: lambda x: col(x).try_cast(t))(_t)


@scalar("is_null", "isnull")
def is_null(x) -> Column:
    return col(x).isNull()


@scalar("if_null", "ifnull", "nvl")
def if_null(a, b) -> Column:
    return F.coalesce(col(a), col(b))


@scalar("nvl2")
def nvl2(a, b, c) -> Column:
    return F.when(col(a).isNotNull(), col(b)).otherwise(col(c))


@scalar("coalesce")
def coalesce(*xs) -> Column:
    return F.coalesce(*map(col, xs))


# ---- arrays, maps, json


@scalar("array_contains")
def array_contains(xs, v) -> Column:
    return F.array_contains(col(xs), col(v))


@scalar("isin")
def isin(v, xs) -> Column:
    return F.array_contains(col(xs), col(v))


@scalar("array_join")
def array_join(xs, d) -> Column:
    """NULL elements are left out."""
    return F.array_join(F.transform(col(xs), lambda x: x.cast("string")), d)


@scalar("array_combine")
def array_combine(d, *arrays) -> Column:
    """All combinations of one element each, joined; the last array varies fastest."""
    out = F.transform(col(arrays[0]), lambda x: x.cast("string"))

    def with_each(left: Column, more: Column) -> Column:
        return F.transform(more, lambda x: F.concat(left, F.lit(d), x.cast("string")))

    def times(done: Column, more: Column) -> Column:
        return F.flatten(F.transform(done, lambda left: with_each(left, more)))

    for a in arrays[1:]:
        out = times(out, col(a))
    return out


@scalar("map")
def map_(*kvs) -> Column:
    return F.create_map(*map(col, kvs))


@scalar("map_keys")
def map_keys(m) -> Column:
    return F.map_keys(col(m))


@scalar("json_array_length")
def json_array_length(s) -> Column:
    return F.json_array_length(col(s))


def json_path(pointer: str) -> str:
    """A JSON pointer (``/a/0``, ``~0``, ``~1``) as a JSON path."""
    out = "$"
    for part in pointer.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        out += f"[{part}]" if part.isdigit() else "['" + part + "']"
    return out


@scalar("get_json_object")
def get_json_object(s, pointer) -> Column:
    """``pointer`` is a literal JSON pointer."""
    return F.get_json_object(col(s), json_path(pointer))


@scalar("element_at")
def element_at(xs, key) -> Column:
    return F.try_element_at(col(xs), col(key))
