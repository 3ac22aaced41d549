"""Frames against a row-by-row model, and published results."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.features import Feature, group_features, request_features, window_features
from tidemark.operators.frames import Frame

BASE = Frame(["k"], "t", tie=["id"])


def model(rows, unions, f):
    """Per id the window's rows, oldest first. rows: (id, k, t, v); union rows come first on equal times."""
    out = {}
    for cur in rows:
        every = [(r, True) for r in rows] + [(r, False) for u in unions for r in u]
        part = sorted(((r, m) for r, m in every if r[1] == cur[1]), key=lambda x: (x[0][2], x[1], x[0][0]))
        at = next(i for i, (r, m) in enumerate(part) if m and r[0] == cur[0])
        past = part[:at]
        if f.kind == "rows_range" and (f.end or f.end_open):
            past = [x for x in part if x[0][2] <= cur[2] - f.end - f.end_open]
        if f.instance_not_in_window:
            past = [x for x in past if not x[1]]
        if f.exclude_current_time:
            past = [x for x in past if x[0][2] < cur[2]]
        if f.kind == "rows":
            start = None if f.start is None else f.start - f.start_open
            end = f.end + f.end_open
            past = past if start is None else past[max(0, len(past) - start) :] if start else []
            window = past + [(cur, True)]
            if end:
                window = window[: len(window) - end]
            elif f.exclude_current_row:
                window = window[:-1]
        else:
            if f.start is not None:
                past = [x for x in past if x[0][2] >= cur[2] - (f.start - f.start_open)]
            current = not (f.end or f.end_open or f.exclude_current_row)
            if f.maxsize is not None:
                keep = f.maxsize - current
                past = past[len(past) - keep :] if 0 < keep < len(past) else past if keep else []
            window = past + ([(cur, True)] if current else [])
        out[cur[0]] = [x[0] for x in window]
    return out


FRAMES = {
    "rows": BASE.rows(2),
    "rows_history": BASE.rows(3, 1),
    "rows_unbounded": BASE.rows(None),
    "rows_open": BASE.rows(3, start_open=True),
    "rows_exclude": BASE.rows(2, exclude_current_row=True),
    "range": BASE.rows_range(10),
    "range_unbounded": BASE.rows_range(None),
    "range_open": BASE.rows_range(10, start_open=True),
    "range_history": BASE.rows_range(12, 3),
    "range_exclude": BASE.rows_range(10, exclude_current_row=True),
    "maxsize": BASE.rows_range(10, maxsize=2),
    "maxsize_one": BASE.rows_range(10, maxsize=1),
    "maxsize_exclude": BASE.rows_range(10, maxsize=2, exclude_current_row=True),
    "maxsize_history": BASE.rows_range(15, 2, maxsize=2),
    "exclude_time": BASE.rows_range(10, exclude_current_time=True),
    "exclude_time_row": BASE.rows_range(10, exclude_current_time=True, exclude_current_row=True),
    "exclude_time_maxsize": BASE.rows_range(10, exclude_current_time=True, maxsize=2),
    "exclude_time_rows": BASE.rows(2, exclude_current_time=True),
    "not_in_window": BASE.rows_range(10, instance_not_in_window=True),
    "not_in_window_maxsize": BASE.rows_range(10, instance_not_in_window=True, maxsize=3),
    "not_in_window_exclude": BASE.rows_range(10, instance_not_in_window=True, maxsize=2, exclude_current_row=True),
    "rows_blocks": BASE.rows(2, block_ms=7, block_rows=3),
    "rows_history_blocks": BASE.rows(5, 2, block_ms=3, block_rows=1),
    "rows_exclude_blocks": BASE.rows(3, exclude_current_row=True, block_ms=100, block_rows=4),
    "range_blocks": BASE.rows_range(10, block_ms=7),
    "range_history_blocks": BASE.rows_range(12, 3, block_ms=4),
    "maxsize_blocks": BASE.rows_range(10, maxsize=2, block_ms=30),
    "exclude_time_blocks": BASE.rows_range(10, exclude_current_time=True, block_ms=5),
    "not_in_window_blocks": BASE.rows_range(10, instance_not_in_window=True, maxsize=3, block_ms=6),
    "not_in_window_rows": BASE.rows(2, instance_not_in_window=True),
}


@pytest.mark.parametrize("name", FRAMES)
def test_frame(spark, name):
    f = FRAMES[name]
    rnd = random.Random(name)
    ids = itertools.count()
    make = lambda n: [(next(ids), rnd.randint(0, 2), rnd.randint(0, 25), rnd.choice([None, 1, 2, 3, 5, 8])) for _ in range(n)]
    rows, other = make(50), make(25)
    schema = "id int, k int, t long, v int"
    use = [other] if "not_in" in name or rnd.random() < 0.5 else []
    f = Frame(**{**f.__dict__, "unions": [spark.createDataFrame(u, schema) for u in use]})
    feats = [Feature(n, "v", alias=n) for n in ("count", "sum", "avg", "min", "max", "median", "var_samp", "first_value", "last_value", "drawdown", "distinct_count")]
    got = {r.id: r for r in window_features(spark.createDataFrame(rows, schema), [(f, feats)]).collect()}
    want = model(rows, use, f)
    assert len(got) == len(rows)
    for i, window in want.items():
        vs = [r[3] for r in window if r[3] is not None]
        r = got[i]
        assert r["count"] == len(vs), (name, i)
        assert r["sum"] == (sum(vs) if vs else None)
        assert r["min"] == (min(vs) if vs else None) and r["max"] == (max(vs) if vs else None)
        assert r["avg"] == (pytest.approx(sum(vs) / len(vs)) if vs else None)
        assert r["first_value"] == (window[0][3] if window else None)
        assert r["last_value"] == (window[-1][3] if window else None)
        assert r["distinct_count"] == len({x[3] or 0 for x in window})
        s = sorted(vs)
        assert r["median"] == (pytest.approx((s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2) if vs else None)
        mean = sum(vs) / len(vs) if vs else 0
        assert r["var_samp"] == (pytest.approx(sum((v - mean) ** 2 for v in vs) / (len(vs) - 1)) if len(vs) > 1 else None)
        fall = max([0.0] + [(a - b) / a for n, a in enumerate(vs) for b in vs[n:]]) if vs else None
        assert r["drawdown"] == (pytest.approx(fall) if vs else None)


def test_equal_times(spark):
    rows = [(0, 0, 111, 0), (1, 0, 111, 0), (2, 99000, 111, 21), (3, 100000, 111, 22), (4, 101000, 111, 23), (5, 100000, 114, 56)]
    df = spark.createDataFrame(rows, "id int, ts long, g int, val int")
    f = Frame(["g"], "ts", tie=["id"]).rows_range("2s", "0s", exclude_current_row=True)
    got = window_features(df, [(f, [Feature("count", "val", alias="c"), Feature("max", "val", alias="x"), Feature("min", "val", alias="n"), Feature("lag", "val", 1, alias="l")])])
    assert sorted((r.id, r.c, r.x, r.n, r.l) for r in got.collect()) == [(0, 0, None, None, None), (1, 1, 0, 0, 0), (2, 0, None, None, 0), (3, 1, 21, 21, 21), (4, 2, 22, 21, 22), (5, 0, None, None, None)]


def test_without_order(spark):
    df = spark.createDataFrame([(1, 100, 20000), (2, 100, 10000), (3, 400, 20000), (4, 400, 10000), (5, 400, 15000)], "id int, gp int, ts long")
    base = Frame(["gp"], None, tie=["id"])
    other = [df]
    frames = [
        base.rows_range(None), base.rows_range(None, exclude_current_row=True), base.rows_range(None, maxsize=1),
        base.rows_range(None, unions=other, instance_not_in_window=True), base.rows_range(None, unions=other, instance_not_in_window=True, exclude_current_row=True),
        base.rows_range(None, unions=other, instance_not_in_window=True, exclude_current_row=True, maxsize=2), base.rows_range(None, unions=other, exclude_current_row=True),
    ]
    got = window_features(df, [(f, [Feature("count", "ts", alias=f"c{i}")]) for i, f in enumerate(frames)])
    counts = {r.id: [r[f"c{i}"] for i in range(7)] for r in got.collect()}
    assert counts == {1: [1, 0, 1, 3, 2, 2, 2], 2: [2, 1, 1, 3, 2, 2, 3], 3: [1, 0, 1, 4, 3, 2, 3], 4: [2, 1, 1, 4, 3, 2, 4], 5: [3, 2, 1, 4, 3, 2, 5]}


def test_union_rows_and_mismatch(spark):
    schema = "id int, k int, v int, t long"
    a = spark.createDataFrame([(1, 20, 30, 0), (4, 20, 33, 3), (5, 21, 34, 4)], schema)
    b = spark.createDataFrame([(2, 20, 31, 1), (3, 20, 32, 2)], schema)
    f = Frame(["k"], "t").rows(2, unions=[b])
    assert sorted((r.id, r.s) for r in window_features(a, [(f, [Feature("sum", "v", alias="s")])]).collect()) == [(1, 30), (4, 96), (5, 34)]
    with pytest.raises(ValueError):
        window_features(a, [(Frame(["k"], "t").rows(2, unions=[b.drop("v")]), [])])


def test_bad_times_give_no_row_and_clashing_names_survive(spark):
    df = spark.createDataFrame([(1, 1, None, 5), (2, 1, -3, 5), (3, 1, 4, 5)], "id int, k int, t long, v int")
    got = window_features(df.withColumn("sum", F.lit("x")), [(BASE.rows(2), [Feature("sum", "v", alias="s")])]).collect()
    assert [(r.id, r["sum"], r.s) for r in got] == [(3, "x", 5)]
    assert window_features(df.filter("false"), [(BASE.rows(2), [Feature("sum", "v", alias="s")])]).collect() == []


@pytest.mark.parametrize("kind", ["smallint", "int", "bigint"])
def test_sum_keeps_its_type(spark, kind):
    df = spark.createDataFrame([(1, 1, 1, 30000), (2, 1, 2, 30000)], "id int, k int, t long, v int").withColumn("v", F.col("v").cast(kind))
    out = window_features(df, [(BASE.rows(2), [Feature("sum", "v", alias="s")])])
    assert dict(out.dtypes)["s"] == kind
    assert sorted(r.s for r in out.collect()) == ([-5536, 30000] if kind == "smallint" else [30000, 60000])


@pytest.mark.parametrize("kind", ["range", "rows", "maxsize", "history", "unbounded"])
def test_request_equals_batch(spark, kind):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, 0, 1, 2, 3]), rnd.randint(0, 60), rnd.randint(0, 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, k int, t long, v int")
    f = {"range": BASE.rows_range(20), "rows": BASE.rows(3), "maxsize": BASE.rows_range(30, maxsize=3), "history": BASE.rows_range(20, 5), "unbounded": BASE.rows_range(None)}[kind]
    feats = [Feature("sum", "v", alias="s"), Feature("count", "v", alias="c"), Feature("max", "v", alias="m")]
    batch = {r.id: (r.s, r.c, r.m) for r in window_features(df, [(f, feats)]).collect()}
    for i in (7, 23, 59):
        row = next(r for r in rows if r[0] == i)
        before = [r for r in rows if (r[2], r[0]) < (row[2], row[0])]
        got = request_features(spark.createDataFrame([row], df.schema), spark.createDataFrame(before, df.schema), [(f, feats)]).collect()
        assert [(r.id, (r.s, r.c, r.m)) for r in got] == [(i, batch[i])]


def test_documented_results(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 8.0), (3, 5.0), (4, 2.0), (5, 10.0), (6, 4.0)], "id int, x double")
    one = group_features(df, [], [Feature("drawdown", "x", alias="d"), Feature("median", "x", alias="m")], order=["id"]).first()
    assert one.d == pytest.approx(0.75) and one.m == 4.5
    small = spark.createDataFrame([(i, float(i), [1, 1, 2, 3, 3][i]) for i in range(5)], "id int, x double, y int")
    r = group_features(small, [], [Feature("ew_avg", "x", 0.5, alias="e"), Feature("top", "y", 3, alias="t"), Feature("topn_frequency", "y", 4, alias="f"), Feature("entropy", "y", alias="h"), Feature("top1_ratio", "y", alias="r")], order=["id"]).first()
    assert r.e == pytest.approx(3.161290, abs=1e-6) and r.t == "3,3,2" and r.f == "1,3,2,NULL" and r.r == pytest.approx(0.4)
    four = spark.createDataFrame([(1,), (1,), (2,), (3,)], "y int")
    assert group_features(four, [], [Feature("entropy", "y", alias="h")]).first().h == pytest.approx(1.5)


def test_categories(spark):
    rows = [(0, True, "x"), (1, False, "y"), (2, False, "x"), (3, True, "y"), (4, True, "x"), (5, None, "z"), (None, True, "z")]
    df = spark.createDataFrame([(1, i, i, *r) for i, r in enumerate(rows)], "k int, id int, t long, v int, c boolean, g string")
    names = {
        "count_cate_where": ("v", "c", "g"), "count_cate": ("v", "g"), "avg_cate": ("v", "g"), "sum_cate_where": ("v", "c", "g"), "max_cate": ("v", "g"), "min_cate": ("v", "g"),
        "top_n_key_count_cate_where": ("v", "c", "g", 1), "top_n_value_sum_cate_where": ("v", "c", "g", 1), "top_n_key_ratio_cate": ("v", "c", "g", 2), "top_n_value_ratio_cate": ("v", "c", "g", 2),
    }
    want = {
        "count_cate_where": "x:2,y:1", "count_cate": "x:3,y:2,z:1", "avg_cate": "x:2.000000,y:2.000000,z:5.000000", "sum_cate_where": "x:4,y:3", "max_cate": "x:4,y:3,z:5", "min_cate": "x:0,y:1,z:5",
        "top_n_key_count_cate_where": "y:1", "top_n_value_sum_cate_where": "x:4", "top_n_key_ratio_cate": "z:0.000000,y:0.500000", "top_n_value_ratio_cate": "x:0.666667,y:0.500000",
    }
    feats = [Feature(n, *a, alias=n) for n, a in names.items()]
    grouped = group_features(df, ["k"], feats).first()
    windowed = {r.id: r for r in window_features(df, [(BASE.rows(None), feats)]).collect()}[6]
    for n, text in want.items():
        assert grouped[n] == text == windowed[n], n


def test_nth_value_and_split(spark):
    df = spark.createDataFrame([(1, 1, 1, True, "a,b"), (2, 1, 2, False, None), (3, 1, 3, None, "c"), (4, 1, 4, True, "d")], "id int, k int, t long, c boolean, s string")
    feats = [Feature("nth_value_where", "id", 2, "c", alias="a"), Feature("nth_value_where", "id", -1, "c", alias="b"), Feature("nth_value_where", "id", 0, "c", alias="z"), Feature("window_split", "s", ",", alias="w")]
    got = {r.id: r for r in window_features(df, [(BASE.rows(10), feats)]).collect()}
    assert (got[3].a, got[3].b, got[4].a, got[4].b, got[4].z, got[4].w) == (None, 1, 4, 4, None, ["d", "c", "a", "b"])
