"""Physical plans: shuffles, pushed filters, pruned columns."""

import re

import pytest

from tidemark.operators.features import Feature, window_features
from tidemark.operators.frames import Frame
from tidemark.plans.dialect import compile_query


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range|Single)", plan(df)))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t"))
    spark.range(100).selectExpr("id", "id % 7 AS k", "id AS t", "id * 2 AS v", "'x' AS unused").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_windows_of_one_partition_share_a_shuffle(table):
    base = Frame(["k"], "t", tie=["id"])
    frames = [base.rows(3), base.rows_range(5), base.rows_range(9, maxsize=2), base.rows_range(5, exclude_current_row=True)]
    df = window_features(table, [(f, [Feature("sum", "v", alias=f"s{i}")]) for i, f in enumerate(frames)], ["id"])
    assert shuffles(df) == 1
    assert "unused" not in re.search(r"ReadSchema: (.*)", plan(df)).group(1)


@pytest.mark.parametrize("frame", [
    dict(kind="rows_range", start=5, maxsize=3), dict(kind="rows_range", start=None, maxsize=3, exclude_current_row=True), dict(kind="rows_range", start=None, exclude_current_time=True), dict(kind="rows", start=4, exclude_current_time=True),
    dict(kind="rows_range", start=5, instance_not_in_window=True), dict(kind="rows_range", start=5, instance_not_in_window=True, maxsize=2), dict(kind="rows", start=None, instance_not_in_window=True), dict(kind="rows_range", start=None, instance_not_in_window=True),
])
def test_frames_that_pick_rows_collect_none(table, frame):
    base = Frame(["k"], "t", tie=["id"], **frame, unions=[table])
    df = window_features(table, [(base, [Feature(n, "v", alias=n) for n in ("count", "sum", "avg", "min", "max")])], ["id"])
    assert "collect_list" not in plan(df) and shuffles(df) == (1 if frame["kind"] == "rows_range" or not frame.get("exclude_current_time") else shuffles(df))


def test_dialect_prunes_and_pushes(spark, table):
    df = compile_query(spark, "SELECT id, v + 1 AS w FROM t WHERE k = 3 AND t > 10", lambda n: table)
    text = plan(df)
    assert shuffles(df) == 0 and "EqualTo(k,3)" in text and "GreaterThan(t,10)" in text and "unused" not in text


def test_last_join_reduces_the_right_side_before_it_joins(spark, table):
    df = compile_query(spark, "SELECT a.id, b.v FROM t AS a LAST JOIN t AS b ORDER BY b.t ON a.k = b.k", lambda n: table)
    text = plan(df)
    assert "CartesianProduct" not in text and "NestedLoop" not in text and re.search(r"partial_max", text)
    asof = plan(compile_query(spark, "SELECT a.id, b.v FROM t AS a LAST JOIN t AS b ORDER BY b.t ON a.k = b.k AND b.t <= a.t", lambda n: table))
    assert "CartesianProduct" not in asof and "NestedLoop" not in asof and "Window" in asof
