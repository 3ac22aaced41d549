import pytest
from pyspark.sql import functions as F

from tidemark.plans.grammar import SqlError, parse_query
from tidemark.plans.session import Session


@pytest.fixture(scope="module")
def session(spark):
    s = Session(spark)
    t1 = [("0", 1, 5, 1.1, 11.1, 1, "1"), ("0", 2, 5, 2.2, 22.2, 2, "22"), ("1", 3, 55, 3.3, 33.3, 1, "333"), ("1", 4, 55, 4.4, 44.4, 2, "4444"), ("2", 5, 55, 5.5, 55.5, 3, "a" * 66)]
    df = spark.createDataFrame(t1, "col0 string, col1 int, col2 int, col3 double, col4 double, col5 bigint, col6 string")
    s.register("t1", df.withColumn("col2", F.col("col2").cast("smallint")))
    s.register("a", spark.createDataFrame([("aa", 2, 3), ("bb", 21, 31), ("cc", 41, 51)], "c1 string, c2 int, c3 bigint"))
    s.register("b", spark.createDataFrame([("aa", 1, 12), ("aa", 2, 13), ("bb", 3, 131), ("dd", 9, 151)], "c1 string, c2 int, c3 bigint"))
    return s


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_range_window_keeps_types(session):
    got = session.sql("SELECT col1, sum(col1) OVER w1 AS a, sum(col2) OVER w1 AS b, sum(col5) OVER w1 AS c FROM t1 WINDOW w1 AS (PARTITION BY col2 ORDER BY col5 ROWS_RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)")
    assert dict(got.dtypes) == {"col1": "int", "a": "int", "b": "smallint", "c": "bigint"}
    assert rows(got) == [(1, 1, 5, 1), (2, 3, 10, 3), (3, 3, 55, 1), (4, 7, 110, 3), (5, 12, 165, 6)]


def test_conditions_on_aggregates_of_the_frame(session):
    q = "SELECT col1, count_where(col1, col5 = first_value(col5)) OVER w AS a, sum_where(col1, col1 < max(col1)) OVER w AS b, count_where(*, col4 >= avg(col4)) OVER w AS c FROM t1 WINDOW w AS (PARTITION BY col2 ORDER BY col5 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    assert rows(session.sql(q)) == [(1, 1, None, 1), (2, 1, 1, 1), (3, 1, None, 1), (4, 1, 3, 1), (5, 1, 7, 2)]
    with pytest.raises(SqlError):
        session.sql("SELECT top(col1, max(col1)) OVER (PARTITION BY col2 ORDER BY col5 ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t1")


def test_group_by_having(session):
    assert rows(session.sql("SELECT col2, sum(col1) AS s, sum(col5) AS t FROM t1 GROUP BY col2")) == [(5, 3, 3), (55, 12, 6)]
    assert rows(session.sql("SELECT col2, count_cate(col1, col0) AS s FROM t1 GROUP BY col2 HAVING sum(col1) > 5")) == [(55, "1:2,2:1")]


def test_last_join(session):
    assert rows(session.sql("SELECT a.c1, a.c2, b.c3 FROM a LAST JOIN b ORDER BY b.c2 ON a.c1 = b.c1")) == [("aa", 2, 13), ("bb", 21, 131), ("cc", 41, None)]
    assert rows(session.sql("SELECT a.c1, b.c3 FROM a LAST JOIN b ORDER BY b.c2 ON a.c1 = b.c1 AND b.c2 < a.c2")) == [("aa", 12), ("bb", 131), ("cc", None)]
    assert rows(session.sql("SELECT a.c1, b.c3 FROM a LEFT JOIN b ON a.c1 = b.c1")) == [("aa", 12), ("aa", 13), ("bb", 131), ("cc", None)]


def test_scalars(session):
    q = """SELECT substr('hello', 2, 3), substr('hello', 0), locate('l', 'hello', 4), concat_ws('-', 'a', NULL), pmod(10, -3), pmod(-10, 0), 7 / 0.0, 7 DIV 0, 7 % 0, regexp_like('abc', 'b'), regexp_like('ABC', 'a.c', 'i'),
    like_match('a_b', 'a#_b', '#'), char_length('é'), round(2.5), bool('Yes'), bool('what'), get_json_object('{"a/b": {"c": [1, 2]}}', '/a~1b/c/1'), join(split_by_key('a:1,b,c:3', ',', ':'), '|'), map('k', 1)['k'], hex(17), int('x'),
    date_format(timestamp(1590738990000), '%Y/%m/%d %H:%M'), CASE 3 WHEN 1 THEN 'x' ELSE 'y' END, 5 IN (1, 5), 3 BETWEEN 1 AND 2, NULL IS NULL, true XOR false, 6 & 3, 6 ^ 3, ~1, array_contains([1, 2], 2), topic.c1 FROM a AS topic WHERE c2 = 2"""
    got = session.sql(q).first()
    assert list(got) == ["ell", "", 4, None, 1, None, float("inf"), None, None, False, True, True, 2, 3, True, None, "2", "a|c", 1, "11", None, "2020/05/29 07:56", "y", True, False, True, True, 2, 5, -2, True, "aa"]


def test_more_forms(session):
    q = """SELECT !(1 > 2), array_contains(ARRAY<INT64>[NULL, 1, 2], 1), CAST(12 AS VARCHAR(60)), map(1, "2", 3, "4")[3] # a comment
    , size(ARRAY<double>[]), - 3 + 1, "it's", 'a''b', 1e3, 1.5f, 10L -- another
    , /* and one */ x.c1 FROM a x LAST JOIN b ORDER BY b.c2 ASC ON x.c1 = b.c1 WHERE !isnull(x.c1) LIMIT 1"""
    assert list(session.sql(q).first())[:11] == [True, True, "12", "4", 0, -2, "it's", "a'b", 1000.0, 1.5, 10]


def test_sample_lines(session):
    q = "SELECT csv(multiclass_label(6), continuous(1.5), discrete(3)), libsvm(multiclass_label(6), continuous(1.5), discrete(3)), gcformat(gcformat_index(2), continuous(1), discrete(3, 100)), csv(discrete(3, -1), discrete(3, 1000), continuous(int('x'))), libsvm(discrete(3, 1000)), gcformat()"
    assert list(session.sql(q).first()) == ["6,1.500000,2681491882390849628", "6 1:1.500000 2681491882390849628:1", " 2| 1:5925585971146611297:1 2:28", ",628,", "629:1", " | "]


def test_sets_with_and_limits(session):
    assert rows(session.sql("WITH x AS (SELECT col2 FROM t1) SELECT col2 FROM x UNION DISTINCT SELECT col2 FROM x")) == [(5,), (55,)]
    assert session.sql("SELECT col1 FROM t1 LIMIT 0").collect() == []
    assert rows(session.sql("SELECT c1, ? AS p FROM a LIMIT 1", [4]))[0][1] == 4


@pytest.mark.parametrize("text", ["SELECT 1 FROM t1 LIMIT 1 OFFSET 2", "SELECT a FROM t INNER JOIN u ON a = b", "SELECT a FROM t INTERSECT SELECT a FROM t", "SELECT sum(a) OVER (PARTITION BY b ORDER BY c RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t", "SELECT a IN () FROM t", "SELECT a IN (SELECT 1) FROM t", "SELECT sum(a) OVER (PARTITION BY b ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) FROM t", "SELECT a.b.c.d FROM t"])
def test_rejected(text):
    with pytest.raises(SqlError):
        parse_query(text)


def test_tables_and_rows(session, tmp_path):
    s = session
    s.sql("CREATE DATABASE IF NOT EXISTS d1")
    s.sql("USE d1")
    s.sql("CREATE TABLE t (id int NOT NULL, k string DEFAULT 'z', ts timestamp, v double, INDEX(KEY=k, TS=ts, TTL=10m, TTL_TYPE=absolute))")
    s.sql("INSERT INTO t VALUES (1, 'a', 1000, 1.5), (2, 'a', 2000, 2.5)")
    s.sql("INSERT INTO t (id, v) VALUES (3, 0)")
    s.sql("INSERT OR IGNORE INTO t VALUES (1, 'a', 1000, 1.5)")
    assert [(r.id, r.k, r.v) for r in s.sql("SELECT * FROM t ORDER BY id").collect()] == [(1, "a", 1.5), (2, "a", 2.5), (3, "z", 0.0)]
    with pytest.raises(SqlError):
        s.sql("INSERT INTO t VALUES (NULL, 'a', 1, 1.0)")
    s.sql("DELETE FROM t WHERE k = 'a' AND id < 2")
    assert s.sql("SELECT count(*) AS n FROM t").first().n == 2
    s.sql(f"SELECT id, k FROM t INTO OUTFILE '{tmp_path}/o' OPTIONS (format='csv', mode='overwrite')")
    s.sql("CREATE TABLE u (id int, k string)")
    s.sql(f"LOAD DATA INFILE '{tmp_path}/o' INTO TABLE u OPTIONS (format='csv', mode='append')")
    s.sql(f"LOAD DATA INFILE '{tmp_path}/o' INTO TABLE u OPTIONS (format='csv', mode='overwrite')")
    assert rows(s.sql("SELECT * FROM u")) == [(2, "a"), (3, "z")]
    assert rows(s.sql("SHOW TABLES")) == [("t",), ("u",)] and s.sql("DESC t").count() == 4
    assert s.expire(["t"], 602_000).count() == 1
    s.sql("TRUNCATE TABLE u")
    assert s.sql("SELECT * FROM u").collect() == []
    s.sql("DROP TABLE u")
    with pytest.raises(SqlError):
        s.sql("SELECT * FROM u")
    assert "Window" in s.sql("EXPLAIN SELECT sum(v) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) FROM t").first().plan
    s.sql("USE default")


def test_deployment_answers_like_the_batch(session):
    q = "SELECT col1, sum(col1) OVER w AS s FROM t1 WINDOW w AS (PARTITION BY col2 ORDER BY col5 ROWS_RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)"
    session.sql(f"DEPLOY d OPTIONS (SYNC='true') {q}")
    assert rows(session.sql("CALL d('9', 100, 55, 1.0, 1.0, 4, 'x')")) == [(100, 112)]
    assert session.sql("SHOW DEPLOYMENTS").first()[0] == "d"


def test_own_functions(session):
    session.register_function("twice", lambda x: x * 2)
    session.register_aggregate("product", F.lit(1).cast("bigint"), lambda a, x: a * x)
    assert rows(session.sql("SELECT twice(col1), product(col1) OVER w FROM t1 WINDOW w AS (PARTITION BY col2 ORDER BY col5 ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"))[-1] == (8, 12)
