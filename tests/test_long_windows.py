"""Deployments with LONG_WINDOWS answer from buckets, as they do without."""

import random

import pytest

from tidemark.plans.grammar import SqlError
from tidemark.plans.session import Session

DAY = 86_400_000
FRAMES = ["3d PRECEDING AND CURRENT ROW", "3d OPEN PRECEDING AND CURRENT ROW", "5d PRECEDING AND 1d PRECEDING", "5d PRECEDING AND CURRENT ROW EXCLUDE CURRENT_ROW", "2h PRECEDING AND CURRENT ROW", "3d PRECEDING AND 5m OPEN PRECEDING"]
#: Each frame takes some of these, as every argument is a plan of its own.
ASKED = ["count(*)", "count(s)", "count(v)", "sum(v)", "sum(b)", "avg(v)", "min(b)", "max(b)", "max(v)", "min(d)", "sum(d)", "count_where(v, b > 0)", "sum_where(v, b > 0)", "avg_where(v, b > 0)", "min_where(b, v > 3)", "max(s)", "distinct_count(v)"]


@pytest.fixture(scope="module")
def session(spark):
    rnd = random.Random(2)
    row = lambda i: (i, rnd.choice(["a", "b", None]), rnd.choice([1, None]), rnd.choice([-5, 2, 4, 2**31 - 1, None]), rnd.choice([-(2**40), 7, 2**62 // 300, None]), rnd.choice([0.5, -2.0, None]), rnd.choice(["x", "y", None]), rnd.choice([None, -1, *[rnd.randrange(8 * DAY)] * 9, 4 * DAY, 5 * DAY]))
    s = Session(spark)
    s.register("t", spark.createDataFrame([row(i) for i in range(300)], "id int, k string, l int, v int, b bigint, d double, s string, ts bigint"))
    asked = [row(i) for i in range(80)]
    s.asked = spark.createDataFrame(asked + asked[:5], s.table(["t"]).schema)
    return s


def text(frame):
    return f"SELECT id, {', '.join(f'{a} OVER w AS f{i}' for i, a in enumerate(ASKED[FRAMES.index(frame) :: len(FRAMES)]))} FROM t WINDOW w AS (PARTITION BY k, l ORDER BY ts ROWS_RANGE BETWEEN {frame})"


@pytest.mark.parametrize("frame", FRAMES)
def test_the_same_answers(session, frame):
    session.sql(f"DEPLOY IF NOT EXISTS p{FRAMES.index(frame)} {text(frame)}")
    session.sql(f"DEPLOY IF NOT EXISTS q{FRAMES.index(frame)} OPTIONS (LONG_WINDOWS='w:6h') {text(frame)}")
    want, got = (sorted(map(repr, session.request(f"{n}{FRAMES.index(frame)}", session.asked).collect())) for n in "pq")
    assert got == want and len(got) > 60


def test_buckets_are_built_and_no_rows_are_collected(session):
    q = "SELECT id, sum(v) OVER w AS s FROM t WINDOW w AS (PARTITION BY k ORDER BY ts ROWS_RANGE BETWEEN 3d PRECEDING AND CURRENT ROW)"
    session.sql(f"DEPLOY plain {q}")
    session.sql(f'DEPLOY long OPTIONS (LONG_WINDOWS="w") {q}')
    plans = [session.request(n, session.asked)._jdf.queryExecution().optimizedPlan().toString() for n in ("plain", "long")]
    assert ["bucket" in p for p in plans] == [False, True] and not any("collect_list" in p for p in plans)
    assert session.long_windows["long"] == {"w": DAY}
    session.sql("DROP DEPLOYMENT long")
    assert "long" not in session.long_windows


@pytest.mark.parametrize("given", ["x:1d", "w:day", "w:0d"])
def test_rejected(session, given):
    with pytest.raises(SqlError):
        session.sql(f"DEPLOY bad OPTIONS (LONG_WINDOWS='{given}') {text(FRAMES[0])}")
