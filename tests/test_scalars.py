import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as s
from tidemark.functions import signature as g


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_null_gives_null(spark):
    null = F.lit(None).cast("string")
    no = F.lit(None).cast("double")
    ts = F.lit(None).cast("timestamp")
    texts = ["concat", "concat_ws", "ucase", "lcase", "reverse", "char_length", "unhex", "hex", "string", "bool", "int", "double", "date", "json_array_length"]
    got = one(spark, *[s.REGISTRY[n](null) if n != "concat_ws" else s.concat_ws("-", "a", null) for n in texts])
    assert got == [None] * len(texts)
    numbers = ["ln", "log2", "abs", "ceil", "floor", "sqrt", "exp", "sin", "cot", "atan", "truncate", "round", "inc", "identity", "degrees"]
    assert one(spark, *[s.REGISTRY[n](no) for n in numbers]) == [None] * len(numbers)
    times = ["year", "month", "day", "dayofweek", "hour", "week", "last_day"]
    assert one(spark, *[s.REGISTRY[n](ts) for n in times]) == [None] * len(times)
    assert one(spark, s.substring(null, 1), s.substring("abc", F.lit(None).cast("int")), s.locate(null, "a"), s.strcmp(null, "a"), s.pmod(F.lit(None).cast("int"), F.lit(2)), s.minimum(no, 1.0), s.datediff(null, "2020-01-01"), s.xor(F.lit(None).cast("boolean"), F.lit(True))) == [None] * 8


def test_strings(spark):
    assert one(spark, s.substring("hello", 4, 9), s.substring("hello", -2), s.substring("hello", 9), s.substring("hello", 2, 0), s.substring("hello", -9, 2)) == ["lo", "lo", "", "", ""]
    assert one(spark, s.locate("", "abc", 2), s.locate("b", "abc", 0), s.locate("z", "abc"), s.locate("b", "abcb", 3)) == [2, 0, 0, 4]
    assert one(spark, s.char(65), s.char(65 + 256), s.replace("aXbX", "X"), s.strcmp("b", "a"), s.hex_(F.lit(17)), s.hex_(F.lit(17.6)), s.hex_(F.lit("ab")), s.unhex("zz")) == ["A", "A", "ab", 1, "11", "12", "6162", None]


@pytest.mark.parametrize(
    "text,pattern,escape,want",
    [("a_b", "a\\_b", "\\", True), ("axb", "a\\_b", "\\", False), ("axb", "a_b", "\\", True), ("a%b", "a#%b", "#", True), ("axxb", "a%b", "\\", True), ("", "%", "\\", True), ("", "_", "\\", False), ("a\\xb", "a\\_b", "", True), ("ab", "AB", "\\", False)],
)
def test_like(spark, text, pattern, escape, want):
    assert one(spark, s.like_match(F.lit(text), pattern, escape)) == [want]
    if text == "ab":
        assert one(spark, s.ilike_match(F.lit(text), pattern, escape)) == [True]


def test_regexp_takes_the_whole_string(spark):
    assert one(spark, s.regexp_like(F.lit("The Lord"), "The Lo.*"), s.regexp_like(F.lit("The Lord"), "Lo"), s.regexp_like(F.lit("ab\ncd"), "ab.cd"), s.regexp_like(F.lit("ab\ncd"), "ab.cd", "s"), s.regexp_like(F.lit("AB"), "ab", "ic"), s.regexp_like(F.lit("AB"), "ab", "ci"), s.regexp_like(F.lit("a"), "(")) == [True, False, False, True, False, True, None]


def test_numbers(spark):
    inf = float("inf")
    got = one(spark, s.divide(1, 0), s.divide(-1, 0), s.divide(0, 0), s.divide(7, 2), s.integer_divide(F.lit(7), F.lit(0)), s.integer_divide(F.lit(-7), F.lit(2)), s.remainder(F.lit(7), F.lit(0)), s.truncate(-1.7), s.round_(2.5), s.round_(F.lit(-2.5)), s.earth_distance(40, 73, 41, 74), s.pmod(F.lit(-10), F.lit(3)))
    assert got[:2] == [inf, -inf] and math.isnan(got[2]) and got[3:10] == [3.5, None, -3, None, -1, 3.0, -3.0] and got[10] == pytest.approx(139.7, abs=0.05) and got[11] == 2


def test_lists_and_json(spark):
    assert one(spark, s.split(F.lit("a.b"), "."), s.split(F.lit("a1b22c"), "[0-9]+"), s.split(F.lit(""), ","), s.split_by_key(F.lit("a:1,b,c:2:3"), ",", ":"), s.split_by_value(F.lit("a:1,b,c:2:3"), ",", ":")) == [["a", "b"], ["a", "b", "c"], [""], ["a", "c"], ["1", "2:3"]]
    items = F.array(F.lit("a:1"), F.lit("b:2"), F.lit("c"))
    assert one(spark, s.list_except_by_key(items, "a"), s.list_except_by_value(items, "2,9"), s.array_join(F.array(F.lit(1), F.lit(None)), "-"), s.array_combine("-", F.array(F.lit("1"), F.lit("2")), F.array(F.lit("3"), F.lit("4")))) == [["b:2", "c"], ["a:1", "c"], "1", ["1-3", "1-4", "2-3", "2-4"]]
    doc = F.lit('{"boo": [1, 2], "a/b": {"~": "t"}}')
    assert one(spark, s.get_json_object(doc, "/boo/0"), s.get_json_object(doc, "/a~1b/~0"), s.get_json_object(doc, "/no"), s.json_array_length(F.lit("[1,2]")), s.json_array_length(F.lit("{")), s.element_at(F.array(F.lit(5)), 1)) == ["1", "t", None, 2, None, 5]


def test_conversions(spark):
    assert one(spark, *[s.bool_(F.lit(x)) for x in ("y", "NO", "1", "f", "maybe", "")]) == [True, False, True, False, None, None]
    assert one(spark, s.REGISTRY["int"](F.lit("99999999999")), s.REGISTRY["smallint"](F.lit("12")), s.date(F.lit("2020-02-30")), s.datediff(F.lit("2020-05-03"), F.lit("2020-05-01"))) == [None, 12, None, 2]
    assert one(spark, F.unix_millis(s.timestamp(F.lit(1590738990000))), F.unix_millis(s.timestamp(F.lit("2020-05-29 07:56:30"))), s.date_format(s.timestamp(F.lit(1590738990000)), "at %H o'clock, 100%%")) == [1590738990000, 1590738990000, "at 07 o'clock, 100%"]


def test_sample_lines_with_nulls(spark):
    null = F.lit(None).cast("int")
    three = F.lit(3)
    features = [g.label(F.lit(2)), g.label(null), g.continuous(null), g.discrete(null), g.continuous(F.lit(-1)), g.discrete(three, 100), g.discrete(null, 100), g.discrete(three, 0), g.discrete(three), g.continuous(F.lit(0.0))]
    got = one(spark, g.csv(*features), g.libsvm(*features), g.gcformat(*features), g.gcformat(), g.libsvm(g.label(F.lit(True))), g.gcformat(g.label(F.lit(False))))
    assert got == ["2,,,,-1,28,,,2681491882390849628,0.000000", "2:-1 31:1 2681491882390849628:1 203:0.000000", " | 3:7262150054277104024:-1 4:28 7:2681491882390849628 8:" + got[2].split("8:")[-1], " | ", "1", "0 | "]
