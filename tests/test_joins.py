import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.joins import asof_join, last_join, last_join_where, left_join
from tidemark.operators.preagg import build_buckets, long_window, merge_buckets
from tidemark.operators.ttl import retain


def sides(spark, seed=3):
    rnd = random.Random(seed)
    left = [(i // 2, rnd.choice([None, 1, 1, 1, 2, 3]), rnd.choice([None, *range(0, 40)])) for i in range(60)]
    right = [(rnd.choice([None, 1, 1, 2, 4]), rnd.choice([None, *range(0, 40)]), i) for i in range(40)]
    right += right[:5]
    return left, right, spark.createDataFrame(left, "id int, k int, t bigint"), spark.createDataFrame(right, "k int, t bigint, v int")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def best(found):
    return max(found, key=lambda r: (-1 if r[1] is None else r[1], r[2]), default=(None, None, None))


def test_last_join(spark):
    left, right, a, b = sides(spark)
    want = [(*l, *best([r for r in right if l[1] is not None and r[0] == l[1]])[1:]) for l in left]
    got = last_join(a, b, ["k"], "t", ["v"], columns=["t", "v"])
    assert got.columns == ["id", "k", "t", "t_r", "v"] and rows(got) == sorted(want, key=str)
    assert last_join(a.filter("false"), b, ["k"], "t").count() == 0
    assert rows(last_join(a, b.filter("false"), ["k"], "t", columns=["v"])) == sorted([(*l, None) for l in left], key=str)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("block", [3000, 86_400_000_000])
def test_asof_join(spark, strict, block):
    left, right, a, b = sides(spark)
    ok = lambda l, r: None not in (l[1], l[2], r[1]) and r[0] == l[1] and (r[1] < l[2] if strict else r[1] <= l[2])
    want = sorted([(*l, *best([r for r in right if ok(l, r)])[1:]) for l in left], key=str)
    assert rows(asof_join(a, b, ["k"], "t", "t", ["v"], strict, ["t", "v"], block_us=block)) == want
    assert rows(last_join_where(a, b, ["k"], f"r.t {'<' if strict else '<='} l.t", "t", ["v"], ["t", "v"])) == want


CONDITIONS = {
    "r.t > l.t": lambda l, r: r[1] > l[2],
    "r.t >= l.t + 0.5": lambda l, r: r[1] >= l[2] + 0.5,
    "l.t > r.v": lambda l, r: l[2] > r[2],
    "r.v < l.t AND l.id > 9 AND r.t > 5": lambda l, r: r[2] < l[2] and l[0] > 9 and r[1] > 5,
    "r.v % 3 = l.id % 3 AND r.t <= l.t": lambda l, r: r[2] % 3 == l[0] % 3 and r[1] <= l[2],
    "r.t = l.t": lambda l, r: r[1] == l[2],
    "l.id > 9 AND r.v > 5": lambda l, r: l[0] > 9 and r[2] > 5,
    "true": lambda l, r: True,
    "timestamp_seconds(r.t * 9000) < timestamp_seconds(l.t * 9000)": lambda l, r: r[1] < l[2],
    "timestamp_seconds(r.v * 9000) >= timestamp_seconds(l.t * 9000)": lambda l, r: r[2] >= l[2],
    "r.t <= l.t AND r.v >= l.id": lambda l, r: r[1] <= l[2] and r[2] >= l[0],
    "(r.t + l.t) % 7 = 3": lambda l, r: (r[1] + l[2]) % 7 == 3,
    "r.t <> l.t OR r.v = 3": lambda l, r: r[1] != l[2] or r[2] == 3,
    "r.t BETWEEN l.t - 5 AND l.t": lambda l, r: l[2] - 5 <= r[1] <= l[2],
}


@pytest.mark.parametrize("condition", CONDITIONS)
@pytest.mark.parametrize("on", [["k"], []])
def test_last_join_where_any_condition(spark, condition, on):
    left, right, a, b = sides(spark)

    def ok(l, r):
        known = None not in (r[1] if "r.t" in condition else 0, l[2] if "l.t" in condition else 0)
        return (not on or l[1] is not None and r[0] == l[1]) and (known and CONDITIONS[condition](l, r) or not known and " OR " in condition and r[2] == 3)

    want = sorted([(*l, *best([r for r in right if ok(l, r)])[1:]) for l in left], key=str)
    got = last_join_where(a, b, on, condition, "t", ["v"], ["t", "v"])
    assert got.columns == ["id", "k", "t", "t_r", "v"] and rows(got) == want
    # a left row's key of another type, and both sides from one table
    assert rows(last_join_where(a.withColumn("k", F.col("k").cast("string")), b, on, condition, "t", ["v"], ["t", "v"]).withColumn("k", F.col("k").cast("int"))) == want


def test_last_join_where_of_one_table(spark):
    df = spark.createDataFrame([(i, i % 3, float(v)) for i, v in enumerate([1, 5, -0.0, 0.0, "nan", 2, "nan", 3, 0.0])], "id int, k int, x double")
    order = lambda v: float("inf") if v != v else v
    data = [tuple(r) for r in df.collect()]
    for sign, ok in (("<", lambda p, q: p < q), (">=", lambda p, q: p >= q)):
        want = [(i, max((j for j, kj, y in data if kj == k and ok(order(y), order(x))), default=None)) for i, k, x in data]
        assert rows(last_join_where(df, df, ["k"], f"r.x {sign} l.x", "id", columns=["id"]).select("id", "id_r")) == sorted(want, key=str)


def nodes(plan):
    """A plan's operators with the rows that each has put out, the last of them the topmost; where that isn't counted, those that it took in."""
    below = [nodes(plan.children().apply(i)) for i in range(plan.children().size())]
    counted = plan.metrics().contains("numOutputRows")
    n = plan.metrics().apply("numOutputRows").value() if counted else sum(b[-1][2] for b in below)
    return [*(x for b in below for x in b), (plan.nodeName(), sum(b[-1][2] for b in below), n)]


@pytest.mark.parametrize(("condition", "pairs"), [("r.t <= l.t", False), ("r.v > l.t", False), ("timestamp_millis(r.t) < timestamp_millis(l.t)", False), ("r.t <= l.t AND r.v % 5 <> l.t % 5", True)])
def test_last_join_where_stores_no_pairs(spark, condition, pairs):
    n = 600
    a, b = spark.range(n).selectExpr("id", "1 AS k", "id AS t"), spark.range(n).selectExpr("1 AS k", "id AS t", "id * 7 % 600 AS v")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = last_join_where(a, b, ["k"], condition, "t", ["v"], ["t", "v"])
        assert len(got.collect()) == n
        seen = nodes(got._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert (max(out for _, _, out in seen) > 10 * n) == pairs
    assert [x for x in seen if x[0] in ("Sort", "SortAggregate", "ObjectHashAggregate", "Exchange", "Window") and x[1] > 2 * n] == []


def test_left_join_and_names(spark):
    left, right, a, b = sides(spark)
    got = left_join(a, b.withColumnRenamed("v", "id"), [("k", "k")], columns=["id"])
    assert got.columns == ["id", "k", "t", "id_r"]
    assert got.count() == sum(max(1, sum(r[0] == l[1] for r in right)) if l[1] is not None else 1 for l in left)


def test_retention(spark):
    df = spark.createDataFrame([(1, 1, 100), (2, 1, 200), (3, 1, 300), (4, 2, 50), (5, 2, None), (6, None, 300)], "id int, k int, t bigint")
    keep = lambda kind, ms=150, n=1: sorted(r.id for r in retain(df, ["k"], "t", kind, 300, ms, n, ["id"]).collect())
    assert keep("absolute") == [2, 3, 6] and keep("latest") == [3, 4, 6] and keep("absorlat") == [3, 6] and keep("absandlat") == [2, 3, 4, 6]
    assert keep("absolute", 0) == keep("latest", 0, 0) == keep("absorlat", 0, 0) == keep("absandlat", 0, 0) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        keep("ever")


def test_long_window(spark):
    rnd = random.Random(8)
    history = [(rnd.choice([1, 1, 2]), rnd.randint(0, 100), rnd.choice([None, 1, 5, 9])) for _ in range(80)]
    df = spark.createDataFrame(history, "k int, t bigint, v int")
    asked = spark.createDataFrame([(1, 50), (1, 50), (1, 99), (2, 3), (3, 9)], "k int, t bigint")
    for window, where in ((35, None), (35, F.col("v") > 1), (4, None), (10, None)):
        parts = [build_buckets(df.filter(c), ["k"], "t", F.col("v"), 10, where) for c in ("t % 2 = 0", "t % 2 = 1")]
        got = long_window(asked, df, merge_buckets(*parts), ["k"], "t", F.col("v"), window, 10, where)
        for r in got.collect():
            vs = [v for k, t, v in history if k == r.k and r.t - window <= t <= r.t and v is not None and (where is None or v > 1)]
            assert (r["count"], r["sum"], r["min"], r["max"]) == (len(vs), sum(vs) if vs else None, min(vs, default=None), max(vs, default=None))
            assert r["avg"] == (pytest.approx(sum(vs) / len(vs)) if vs else None)
        assert got.count() == 5
