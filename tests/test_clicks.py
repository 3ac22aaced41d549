"""Operators over events against plain Python, with NULLs, repeats, hot keys and empty tables."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators.clicks import clicks
from tidemark.operators.feature_table import event_counts, feature_table, type_list
from tidemark.operators.latest import latest_version
from tidemark.operators.rolling import daily_totals, rolling_totals, with_silent_days
from tidemark.operators.sessions import sessions
from tidemark.operators.skew import heavy_keys, skewed_groups
from tidemark.plans import click_queries as q
from tidemark.timeutil import DAY_US, day_number, micros

SCHEMA = "click_id bigint, ip int, app int, device int, os int, channel int, click_time timestamp_ntz, is_attributed int, ingest_time timestamp_ntz"
START = dt.datetime(2013, 1, 7)
EPOCH = dt.datetime(1970, 1, 1)


def table(seed=1, n=400):
    """Deliveries with a hot ip, repeats, and unknown values of both kinds."""
    rnd, rows = random.Random(seed), []
    for i in range(n):
        ip = 7 if rnd.random() < 0.4 else rnd.choice([None, 1, 2, 3, 4])
        t = rnd.choice([None, EPOCH]) if rnd.random() < 0.1 else START + dt.timedelta(seconds=rnd.choice([600, 1800, 86400]) * rnd.randint(0, 40))
        row = [i, ip, rnd.choice([None, 1, 2, 3]), rnd.choice([-1, 0, 5, None]), 1, rnd.choice([None, 10, 20]), t, rnd.choice([0, 1, None])]
        for d in range(rnd.choice([1, 1, 3])):
            rows.append((*row, START + dt.timedelta(days=50, seconds=10 * i + d)))
            row[1] = rnd.choice([row[1], row[1], None])
    return rows


def held(rows):
    last = {}
    for r in rows:
        if r[0] not in last or r[8] > last[r[0]][8]:
            last[r[0]] = r
    out = []
    for r in last.values():
        us = None if r[6] in (None, EPOCH) else int((r[6] - EPOCH) / dt.timedelta(microseconds=1))
        out.append({"ip": r[1], "app": r[2], "device": None if r[3] == -1 else r[3], "channel": r[5], "t": us, "a": r[7]})
    return out


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(table(), SCHEMA).write.parquet(f"{path}/train_schema.parquet")
    empty = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/train_schema.parquet")
    return path, empty


def test_latest_version(spark):
    rows = [(1, 5, "a"), (1, 7, "b"), (1, 7, "c"), (2, None, "d"), (2, None, None), (None, 1, "x"), (None, 1, "x"), (3, 9, None)]
    df = spark.createDataFrame(rows, "k int, v int, __row string").repartition(3)
    got = latest_version(df, "k", F.col("v"), {"value": F.col("__row")})
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "c"), (2, "d"), (3, None), (None, "x"), (None, "x")], key=str)


def test_clicks_hold_the_last_delivery(spark, raw):
    rows = table()
    got = clicks(spark.read.parquet(raw[0] + "/train_schema.parquet"), "ip", "device", "click_time").drop("click_id")
    assert Counter(map(tuple, got.collect())) == Counter((r["ip"], r["device"], r["t"]) for r in held(rows))


def test_times_don_t_depend_on_the_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2013, 3, 10, 2, 30, 0, 123456),), (None,), (dt.datetime(1969, 12, 31, 23, 59, 59),)], "t timestamp_ntz")
    want = [r[0] for r in df.select(micros(df, "t")).collect()]
    assert want[0] == int((dt.datetime(2013, 3, 10, 2, 30, 0, 123456) - EPOCH) / dt.timedelta(microseconds=1)) and want[1] is None and want[2] == -1_000_000
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert [r[0] for r in df.select(micros(df, "t")).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_feature_table(spark, raw):
    got = {r.ip: r for r in q.p1_features(spark, raw[0]).collect()}
    events = [e for e in held(table()) if e["ip"] is not None]
    as_of = max(int((r[6] - EPOCH) / dt.timedelta(microseconds=1)) for r in table() if r[6] not in (None, EPOCH))
    assert set(got) == {e["ip"] for e in events}
    for ip, r in got.items():
        mine = [e for e in events if e["ip"] == ip]
        assert r.clicks == len(mine)
        for a in (1, 2, 3):
            of = [e for e in mine if e["app"] == a]
            times = [e["t"] for e in of if e["t"] is not None]
            if not of:
                assert r[f"app_{a}"] is None
                continue
            assert r[f"app_{a}"].clicks == len(of)
            assert r[f"app_{a}"].clicks_7d == sum(as_of - t < 7 * DAY_US for t in times)
            assert r[f"app_{a}"].since_last_s == (pytest.approx((as_of - max(times)) / 1e6) if times else None)
        pairs = Counter(f"{e['app']}:{e['channel']}" for e in mine if e["app"] is not None and e["channel"] is not None)
        assert {k: v.clicks for k, v in r.app_channel.items()} == pairs
    assert q.p1_features(spark, raw[1]).collect() == []


def test_feature_table_refuses_too_many_types(spark):
    with pytest.raises(ValueError):
        type_list(spark.range(10), "id", limit=5)
    df = spark.createDataFrame([("x'y", "u", 1, 5)], "t string, m string, e int, us bigint")
    out = feature_table(event_counts(df, "e", ["t", "m"], "us", 10), "e", "t", "m", type_list(df, "t"), 10)
    assert out.first()["t_x'y"].clicks == 1


@pytest.mark.parametrize("share", [0.05, 0.5, 1.0])
def test_skewed_groups(spark, raw, share):
    df = spark.read.parquet(raw[0] + "/train_schema.parquet").withColumn("heavy", F.lit(1))
    got = skewed_groups(df, ["ip", "app"], "click_id", {"s": ("sum", F.col("is_attributed")), "n": ("count", F.col("device")), "lo": ("min", F.col("os"))}, share)
    want = defaultdict(list)
    for r in table():
        want[r[1], r[2]].append(r)
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        mine = want[r.ip, r.app]
        known = [x[7] for x in mine if x[7] is not None]
        assert (r.rows, r.distinct_click_id, r.s, r.n, r.lo) == (len(mine), len({x[0] for x in mine}), sum(known) if known else None, sum(x[3] is not None for x in mine), 1)
        if len(mine) >= share * len(table()):
            assert r.heavy


def test_a_null_key_and_a_hot_key_are_spread(spark, tmp_path):
    """Three rows in ten have no key and every second one has the same; no partition of either shuffle holds much of them."""
    df = spark.range(0, 40000, 1, 8).select(F.expr("CASE WHEN id % 10 < 3 THEN NULL WHEN id % 10 < 8 THEN 7 ELSE id END").cast("int").alias("k"), F.col("id").alias("d"), F.lit(1).alias("v"))
    assert {r.k for r in heavy_keys(df, ["k"], 0.05).collect() if r.estimate > 2000} == {None, 7}
    out = skewed_groups(df, ["k"], "d", {"s": ("sum", F.col("v")), "m": ("max", F.col("d"))}, 0.05)
    found = {r.k: r for r in out.collect()}
    assert len(found) == 8002 and [(found[k].rows, found[k].distinct_d, found[k].s, found[k].heavy) for k in (None, 7)] == [(12000, 12000, 12000, True), (20000, 20000, 20000, True)]
    spread = df.filter("k IS NULL OR k = 7").groupBy("k", "d").count().repartition(8, "k", "d").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in spread) < 1.2 * 32000 / 8
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_found_pairs_come_from_both_halves(spark, raw):
    plan = q.p2_found(spark, raw[0])._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan and "Union" in plan


def test_skew_queries_and_empty(spark, raw):
    counts = Counter((r[1], r[2]) for r in table())
    assert {tuple(r) for r in q.p2_found(spark, raw[0]).collect()} == {k for k, n in counts.items() if None not in k and n * 100 >= len(table())}
    assert q.p2_found(spark, raw[1]).collect() == [] and heavy_keys(spark.read.parquet(raw[1] + "/train_schema.parquet"), ["ip"], 0.01).collect() == []
    with pytest.raises(ValueError):
        heavy_keys(spark.range(1), ["id"], 0)


@pytest.mark.parametrize("windows", [(7, 30), (1, 2, 5, 16, 31)])
def test_rolling_totals(spark, raw, windows):
    events = clicks(spark.read.parquet(raw[0] + "/train_schema.parquet"), "ip", "click_time", "is_attributed")
    daily = daily_totals(events, "ip", day_number(F.col("time_us")), {"clicks": F.lit(1).cast("long"), "day_total": F.col("is_attributed").cast("long")})
    got = rolling_totals(with_silent_days(daily, "ip", ["clicks", "day_total"]), "ip", ["clicks", "day_total"], windows)
    per = defaultdict(Counter)
    for e in held(table()):
        if e["ip"] is not None and e["t"] is not None:
            per[e["ip"]][e["t"] // DAY_US, 0] += 1
            per[e["ip"]][e["t"] // DAY_US, 1] += e["a"] or 0
    want = {}
    for ip, c in per.items():
        days = {d for d, i in c if i == 0}
        for d in range(min(days), max(days) + 1):
            want[ip, d] = [sum(c[d - b, i] for b in range(w)) for w in windows for i in (0, 1)]
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        assert [r[f"{m}_{w}d"] for w in windows for m in ("clicks", "day_total")] == want[r.ip, r.day]
        assert r[f"clicks_avg_{windows[-1]}d"] == pytest.approx(r[f"clicks_{windows[-1]}d"] / windows[-1])
    assert q.p5_rolling(spark, raw[1]).collect() == [] and q.p5_found(spark, raw[1]).collect() == []


def test_sessions(spark, raw):
    got = {tuple(r) for r in q.p6_found(spark, raw[0]).collect()}
    per = defaultdict(list)
    for e in held(table()):
        if None not in (e["ip"], e["device"], e["t"]):
            per[e["ip"], e["device"]].append(e["t"])
    want = set()
    for k, ts in per.items():
        run = []
        for t in sorted(ts):
            if run and t - run[-1] > q.GAP_US:
                want.add((*k, run[0] // 1000, run[-1] // 1000))
                run = []
            run.append(t)
        want.add((*k, run[0] // 1000, run[-1] // 1000))
    assert got == want
    assert q.p6_found(spark, raw[1]).collect() == []


def test_session_ends_after_more_than_the_gap(spark):
    gap = 1_800_000_000
    df = spark.createDataFrame([(1, 1, 0), (1, 1, gap), (1, 1, 2 * gap + 1), (2, 1, -5), (2, 1, -5), (None, 1, 3), (1, None, 3), (1, 1, None)], "ip int, first_us int, t bigint")
    got = sessions(df.withColumnRenamed("first_us", "device"), ["ip", "device"], "t", gap).select("ip", "start_us", "end_us", "events").collect()
    assert sorted(map(tuple, got)) == [(1, 0, gap, 2), (1, 2 * gap + 1, 2 * gap + 1, 1), (2, -5, -5, 2)]
