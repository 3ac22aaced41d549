"""Queries that take every row of their tables, against their SQL."""

from collections import Counter

import __spark_entry__
import duckdb
import pytest


def wanted(name: str, folder, tables) -> Counter:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return Counter(db.execute(__spark_entry__.oracle_sql()[name]).fetchall())


def got(spark, name: str, folder) -> Counter:
    return Counter(tuple(r) for r in __spark_entry__.queries()[name](spark, str(folder)).collect())


def test_math_of_customers_beyond_the_domain_of_acos(spark, tmp_path):
    duckdb.execute(f"COPY (SELECT k AS c_custkey, k * 1.5 - 100 AS c_acctbal FROM (SELECT unnest([0, 1, 1499, 1500, 1999, 2000, 2001, 14999, 149999]) AS k)) TO '{tmp_path}/customer.parquet'")
    found = got(spark, "functions_math_more", tmp_path)
    assert sorted(r[0] for r in found) == [0, 1, 1499, 1500, 1999, 2000, 2001, 14999, 149999]
    for a, b in zip(sorted(found), sorted(wanted("functions_math_more", tmp_path, ["customer"]))):
        assert a == pytest.approx(b)


@pytest.mark.parametrize("name", ["request_window", "deployed_query"])
def test_requests_with_null_keys_and_values_and_repeated_ones(spark, tmp_path, name):
    at = "TIMESTAMPTZ '2013-02-05 10:00:00+00' + INTERVAL 1 HOUR * h"
    rest = "CAST(1 AS BIGINT) AS c4, CAST(1 AS FLOAT) AS c5, CAST(1 AS DOUBLE) AS c6, DATE '2013-02-05' AS c8"
    rows = lambda values: f"SELECT CAST(id AS INTEGER) AS id, CAST(c1 AS VARCHAR) AS c1, CAST(c3 AS INTEGER) AS c3, {at} AS c7, {rest} FROM (VALUES {values}) t(id, c1, c3, h)"
    duckdb.execute(f"COPY ({rows('(1, NULL, 5, 0), (2, NULL, NULL, 1), (3, $$a$$, 7, 1), (4, $$a$$, 9, -40), (5, $$b$$, 1, 0)')}) TO '{tmp_path}/udaf_t.parquet'")
    asked = "(1, NULL, 3, 2), (1, NULL, 3, 2), (2, NULL, NULL, 2), (3, $$a$$, NULL, 2), (3, $$a$$, 8, 2), (3, $$a$$, 8, 2), (4, $$c$$, NULL, 2), (5, $$b$$, 4, NULL)"
    duckdb.execute(f"COPY ({rows(asked)}) TO '{tmp_path}/union_t.parquet'")
    found = got(spark, name, tmp_path)
    assert sum(found.values()) == 7 and found == wanted(name, tmp_path, ["udaf_t", "union_t"])
