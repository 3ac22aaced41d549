"""Statements: requests in CONFIG, procedures, own functions, what is shown, inserts, options."""

import pytest

from tidemark.functions import scalar
from tidemark.plans.grammar import SqlError
from tidemark.plans.session import Session


@pytest.fixture
def s(spark, tmp_path):
    s = Session(spark, str(tmp_path))
    s.sql("CREATE TABLE t1 (id int NOT NULL, val string DEFAULT 'none', ts timestamp, INDEX(KEY=id, TS=ts, TTL_TYPE=latest, TTL=5))")
    s.sql("INSERT INTO t1 VALUES (10, 'a', 1000), (10, NULL, 2000), (11, 'c', 3000)")
    return s


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_request_in_config(s):
    query = "SELECT id, count(val) OVER (PARTITION BY id ORDER BY ts ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS n FROM t1 "
    assert rows(s.sql(query + "CONFIG (execute_mode = 'request', values = (10, 'foo', timestamp(4000)))")) == [(10, 2)]
    assert rows(s.sql(query + "CONFIG (execute_mode = 'request', values = [(10, 'foo', 4000), (12, NULL, 5000)])")) == [(10, 2), (12, 0)]
    assert rows(s.sql(query + "CONFIG (execute_mode = 'offline')")) == [(10, 1), (10, 1), (11, 1)]
    for wrong in ("(execute_mode = 'request')", "(values = (1, 'x', 2))", "(speed = 3)", "(execute_mode = 'fast')"):
        with pytest.raises(SqlError):
            s.sql(query + "CONFIG " + wrong)


def test_window_over_joined_tables_for_requests(s):
    s.sql("CREATE TABLE t2 (id int, w int)")
    s.sql("INSERT INTO t2 VALUES (10, 3), (11, 5), (10, 4)")
    query = "SELECT t1.id, sum(t2.w) OVER x AS s FROM t1 LAST JOIN t2 ORDER BY t2.w ON t1.id = t2.id WINDOW x AS (PARTITION BY t2.w ORDER BY t1.ts ROWS_RANGE BETWEEN 5s PRECEDING AND CURRENT ROW)"
    s.sql("DEPLOY d " + query)
    requests = s.spark.createDataFrame([(10, "x", 1500), (10, "x", 2500), (11, "x", 99000), (12, "x", 2500)], "id int, val string, ms bigint").selectExpr("id", "val", "timestamp_millis(ms) AS ts")
    assert rows(s.request("d", requests)) == [(10, 12), (10, 8), (11, 5), (12, None)]
    over = "SELECT id, sum(w) OVER x AS s FROM (SELECT t1.id AS id, t1.ts AS ts, t2.w AS w FROM t1 LAST JOIN t2 ORDER BY t2.w ON t1.id = t2.id) AS j WINDOW x AS (PARTITION BY w ORDER BY ts ROWS_RANGE BETWEEN 5s PRECEDING AND CURRENT ROW)"
    s.sql("DEPLOY e " + over)
    assert rows(s.request("e", requests)) == rows(s.request("d", requests))


def test_procedures(s):
    s.sql("CREATE PROCEDURE p (CONST id int, val string, ts timestamp) BEGIN SELECT id, count(id) OVER w AS n FROM t1 WINDOW w AS (PARTITION BY id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW); END;")
    assert rows(s.sql("CALL p(10, 'x', 9000)")) == [(10, 3)]
    assert [r.name for r in s.sql("SHOW PROCEDURES").collect()] == ["p"]
    shown = s.sql("SHOW CREATE PROCEDURE p").first()
    assert shown.inputs == "id int, val string, ts timestamp" and shown.outputs == "id int, n bigint"
    with pytest.raises(SqlError):
        s.sql("CREATE PROCEDURE q (id string) BEGIN SELECT id FROM t1; END;")
    s.sql("DROP PROCEDURE p")
    with pytest.raises(SqlError):
        s.sql("CALL p(10, 'x', 9000)")


def test_own_functions(s, tmp_path):
    file = tmp_path / "own.py"
    file.write_text("def cut2(x):\n    return x.str[:2]\n\ndef far_init():\n    return (0, 0)\n\ndef far_update(a, v):\n    return (a[0] + v, a[1] + 1)\n\ndef far_merge(a, b):\n    return (a[0] + b[0], a[1] + b[1])\n\ndef far_output(a):\n    return a[0] * 10.0 + a[1]\n")
    s.sql(f"CREATE FUNCTION cut2(string) RETURNS string OPTIONS (FILE='{file}')")
    s.sql(f"CREATE AGGREGATE FUNCTION far(int) RETURNS double OPTIONS (FILE='{file}')")
    assert rows(s.sql("SELECT cut2('abcd') AS c FROM t1")) == [("ab",)] * 3
    assert rows(s.sql("SELECT id, far(id) OVER w AS f FROM t1 WINDOW w AS (PARTITION BY id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")) == [(10, 101.0), (10, 202.0), (11, 111.0)]
    assert rows(s.sql("SELECT far(id) AS f FROM t1 GROUP BY id")) == [(111.0,), (202.0,)]
    with pytest.raises(SqlError):
        s.sql(f"CREATE FUNCTION cut2(string) RETURNS string OPTIONS (FILE='{file}')")
    with pytest.raises(ValueError):
        s.sql(f"CREATE FUNCTION absent(string) RETURNS string OPTIONS (FILE='{file}')")
    s.sql("DROP FUNCTION cut2")
    s.sql("DROP AGGREGATE FUNCTION far")
    assert "cut2" not in scalar.REGISTRY
    with pytest.raises(SqlError):
        s.sql("DROP FUNCTION cut2")


def test_what_is_shown(s):
    statement = s.sql("SHOW CREATE TABLE t1").first().statement
    again = Session(s.spark)
    again.sql(statement)
    assert again.sql("SHOW CREATE TABLE t1").first().statement == statement
    t = again.find(("t1",))
    assert t.schema == s.find(("t1",)).schema and t.required == ["id"] and t.defaults == {"val": "none"} and t.indexes == s.find(("t1",)).indexes
    assert [(r.name, r.rows, r.indexes) for r in s.sql("SHOW TABLE STATUS").collect()] == [("t1", 3, 1)]
    s.sql("DEPLOY d SELECT id FROM t1")
    assert s.sql("SHOW DEPLOYMENT d").first().query == "SELECT id FROM t1"
    with pytest.raises(SqlError):
        s.sql("SHOW DEPLOYMENT none")


def test_insert_is_one_plan(s):
    s.sql("INSERT INTO t1 (id, ts) VALUES " + ", ".join(f"({i}, {i * 1000})" for i in range(2000)))
    s.sql("INSERT INTO t1 VALUES (1 + 1, concat('a', 'b'), timestamp('2020-01-01 00:00:00')), (7, 'true', '2020-01-02 00:00:00')")
    df = s.sql("SELECT id, val, ts FROM t1")
    assert df.count() == 2005 and df.filter("val = 'none'").count() == 2000 and df.filter("val = 'ab'").count() == 1 and df.filter("ts IS NULL").count() == 0
    built = s._rows(s.find(("t1",)).schema, ["id"], [[e] for e in [__import__("tidemark.plans.grammar", fromlist=["Literal"]).Literal(i) for i in range(500)]], {})
    assert "Union" not in built._jdf.queryExecution().optimizedPlan().toString()
    for wrong in ("(NULL, 'x', 1)", "(1, 'x')"):
        with pytest.raises(SqlError):
            s.sql(f"INSERT INTO t1 VALUES {wrong}")


def test_words_in_a_literal_are_no_clause(s, tmp_path):
    assert rows(s.sql("SELECT 'INTO OUTFILE x' AS a FROM t1 LIMIT 1")) == [("INTO OUTFILE x",)]
    s.sql(f"SELECT id, 'INTO OUTFILE' AS a FROM t1 INTO OUTFILE '{tmp_path}/out' OPTIONS (format='parquet')")
    assert s.spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_options_that_are_not_served(s, tmp_path):
    with pytest.raises(ValueError):
        s.sql(f"SELECT id FROM t1 INTO OUTFILE '{tmp_path}/o' OPTIONS (format='csv', colour='red')")
    with pytest.raises(SqlError):
        s.sql("DEPLOY x OPTIONS (colour='red') SELECT id FROM t1")
    s.sql(f"SELECT id FROM t1 INTO OUTFILE '{tmp_path}/o' OPTIONS (format='csv', thread=4)")


def test_an_indexed_table_is_loaded_in_ranges_of_its_keys(s, tmp_path):
    s.spark.range(0, 4000, 1, 4).selectExpr("CAST(id * 7919 % 50 AS int) AS k", "id AS t", "id * 2 AS v").write.parquet(f"{tmp_path}/in")
    s.sql("CREATE TABLE big (k int, t bigint, v bigint, INDEX(KEY=k, TS=t))")
    aqe = s.spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    s.spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        s.sql(f"LOAD DATA INFILE '{tmp_path}/in' INTO TABLE big OPTIONS (format='parquet', mode='append')")
    finally:
        s.spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", aqe)
    spans = sorted(tuple(r) for r in s.table(("big",)).selectExpr("input_file_name() AS f", "struct(k, t) AS e").groupBy("f").agg({"e": "min"}).selectExpr("`min(e)`.k", "`min(e)`.t").collect())
    ends = sorted(tuple(r) for r in s.table(("big",)).selectExpr("input_file_name() AS f", "struct(k, t) AS e").groupBy("f").agg({"e": "max"}).selectExpr("`max(e)`.k", "`max(e)`.t").collect())
    assert len(spans) > 1 and all(end < start for end, start in zip(ends, spans[1:]))
    assert s.sql("SELECT v FROM big WHERE k = 3").count() == 80
