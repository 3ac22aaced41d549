"""Queries that use every aggregate by category, every alias and every form of request over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.features import Feature, group_features, window_features
from tidemark.plans.dialect import compile_query
from tidemark.plans.session import Session
from tidemark.plans.table_queries import _BEST, _RANKED, BASE, HOUR
from tidemark.storage import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], SQL[name] = f, oracle
        return f

    return add


def dialect(name: str, text: str, oracle: str) -> None:
    query(name, oracle)(lambda spark, sf: compile_query(spark, text, lambda n: _table(spark, sf, n[-1])))


# ---- aggregates by category: each name, over a window and over groups

_HOW = ("count", "sum", "avg", "min", "max")
#: name -> what is given out of the categories: their value in SQL, which of them, and in which order.
_CATEGORIES = (
    {f"{h}_cate": (h, "true", "up") for h in _HOW}
    | {f"{h}_cate_where": (f"{h}w", "nw > 0", "up") for h in _HOW}
    | {f"top_n_key_{h}_cate_where": (f"{h}w", "nw > 0", "key") for h in _HOW}
    | {f"top_n_value_{h}_cate_where": (f"{h}w", "nw > 0", "value") for h in _HOW}
    | {f"top_n_{t}_ratio_cate": ("ratio", "true", t) for t in ("key", "value")}
)
_TOP = 2


def _category_features() -> list[Feature]:
    out = []
    for name, (value, _, order) in _CATEGORIES.items():
        args = ["c3", "c9"] if name.endswith("_cate") and value != "ratio" else ["c3", "c10", "c9"]
        out.append(Feature(name, *args, *([_TOP] if order != "up" else []), alias=f"f_{name}"))
    return out


def _category_sql(rows: str, of: str, every: str) -> str:
    """All aggregates of table ``rows`` (``of``, c3, c9, c10) for each ``of`` of table ``every`` under the name of ``shown``."""
    where = " FILTER (WHERE c10)"
    values = ", ".join(f"{'CAST(' if h == 'sum' else ''}{h}(c3){w}{' AS INTEGER)' if h == 'sum' else ''} AS {h}{s}" for h in _HOW for w, s in (("", ""), (where, "w")))
    text = lambda v: f"printf('%.6f', {v})" if v in ("avg", "avgw", "ratio") else v
    picked = []
    for name, (value, which, order) in _CATEGORIES.items():
        sort = {"up": "encode(c9)", "key": "encode(c9) DESC", "value": f"{value} DESC, encode(c9) DESC"}[order]
        inner = f"SELECT o, c9, {value}, row_number() OVER (PARTITION BY o ORDER BY {sort}) AS k FROM g WHERE {which}"
        picked.append(f"{name}_t AS (SELECT o, string_agg(c9 || ':' || {text(value)}, ',' ORDER BY k) AS v FROM ({inner}) x{'' if order == 'up' else f' WHERE k <= {_TOP}'} GROUP BY o)")
    joins = " ".join(f"LEFT JOIN {n}_t ON {n}_t.o IS NOT DISTINCT FROM e.{of}" for n in _CATEGORIES)
    shown = ", ".join(f"coalesce({n}_t.v, '') AS f_{n}" for n in _CATEGORIES)
    return f"""{rows}, g AS (SELECT o, c9, {values}, count(*) FILTER (WHERE c10) AS nw, avg(CASE WHEN c10 THEN 1.0 ELSE 0.0 END) AS ratio FROM p WHERE c3 IS NOT NULL AND c9 IS NOT NULL GROUP BY o, c9),
{", ".join(picked)} SELECT e.{every}, {shown} FROM {"r" if every == "id" else "(SELECT DISTINCT c1 FROM udaf_t)"} e {joins}"""


@query("window_categories_all", _category_sql(_RANKED + ", p AS (SELECT c.rid AS o, x.c3, x.c9, x.c10 FROM r c JOIN r x ON x.c1 IS NOT DISTINCT FROM c.c1 AND x.rn BETWEEN c.rn - 6 AND c.rn)", "rid", "id"))
def _window(spark: SparkSession, sf: str) -> DataFrame:
    return window_features(_table(spark, sf, "udaf_t"), [(BASE.rows(6), _category_features())], ["id"])


@query("group_categories_all", _category_sql("WITH p AS (SELECT c1 AS o, c3, c9, c10 FROM udaf_t)", "c1", "c1"))
def _group(spark: SparkSession, sf: str) -> DataFrame:
    return group_features(_table(spark, sf, "udaf_t"), ["c1"], _category_features())


_PAIRS = _RANKED + ", p AS (SELECT c.rid AS o, x.c9, x.c3, x.rn FROM r c JOIN r x ON x.c1 IS NOT DISTINCT FROM c.c1 AND x.rn BETWEEN c.rn - 2 AND c.rn WHERE x.c9 IS NOT NULL AND x.c3 IS NOT NULL)"


@query(
    "window_split_pairs",
    _PAIRS
    + """, s AS (SELECT o, string_agg(c9 || '|k' || c3, '|' ORDER BY rn DESC) AS k, string_agg(c3 || '|' || c3, '|' ORDER BY rn DESC) AS v FROM p GROUP BY o)
SELECT r.id, coalesce(s.k, '') AS f_keys, coalesce(s.v, '') AS f_values, lag(c3, 2) OVER (PARTITION BY c1 ORDER BY rn) AS f_at FROM r LEFT JOIN s ON s.o = r.rid""",
)
def _split_pairs(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.col("c9"), F.lit("="), F.col("c3"), F.lit(";k"), F.col("c3"), F.lit("="), F.col("c3"))
    feats = [Feature("window_split_by_key", text, ";", "=", alias="k"), Feature("window_split_by_value", text, ";", "=", alias="v"), Feature("at", "c3", 2, alias="f_at")]
    out = window_features(_table(spark, sf, "udaf_t"), [(BASE.rows(2), feats)], ["id"])
    return out.select("id", F.array_join("k", "|").alias("f_keys"), F.array_join("v", "|").alias("f_values"), "f_at")


dialect(
    "group_aliases",
    "SELECT c1, round(std(c3), 4) AS a, round(variance(c3), 4) AS b, round(stddev_samp(c3), 4) AS c FROM udaf_t GROUP BY c1",
    "SELECT c1, round(stddev_samp(c3), 4) AS a, round(var_samp(c3), 4) AS b, round(stddev_samp(c3), 4) AS c FROM udaf_t GROUP BY c1",
)
dialect(
    "functions_aliases",
    """SELECT c_custkey, upper(c_mktsegment) AS a, lower(c_name) AS b, ceiling(c_acctbal) AS c, power(c_nationkey, 2) AS d, int32(c_custkey) AS e, int64(c_nationkey) AS f, int16(c_custkey % 1000) AS g, isnull(c_name) AS h,
farm_fingerprint(c_name) = hash64(c_name) AS i FROM customer""",
    """SELECT c_custkey, upper(c_mktsegment) AS a, lower(c_name) AS b, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(pow(c_nationkey, 2) AS DOUBLE) AS d, CAST(c_custkey AS INTEGER) AS e, CAST(c_nationkey AS BIGINT) AS f, CAST(c_custkey % 1000 AS SMALLINT) AS g, c_name IS NULL AS h,
true AS i FROM customer""",
)
dialect(
    "functions_time_aliases",
    "SELECT event_id, day(ts) AS a, week(ts) AS b, timestamp(unix_timestamp(ts) * 1000) <= ts AS c FROM events",
    "SELECT event_id, CAST(day(ts) AS INTEGER) AS a, CAST(weekofyear(ts) AS INTEGER) AS b, true AS c FROM events",
)
# goldens of the fingerprint and of the three forms of lines: fixed values
dialect(
    "sample_lines_golden",
    """SELECT o_orderkey, csv(regression_label(6), continuous(1.5), discrete(3)) AS a, libsvm(multiclass_label(6), continuous(1.5), discrete(3)) AS b, gcformat(multiclass_label(6), continuous(1.5), discrete(3)) AS c,
gcformat(gcformat_index(o_custkey), regression_label(o_orderkey)) AS d, hash64(3) AS e,
gcformat(discrete(3, 1000), discrete(1, 5), discrete(0 - 4, 5)) AS f FROM orders""",
    """SELECT o_orderkey, '6,1.500000,2681491882390849628' AS a, '6 1:1.500000 2681491882390849628:1' AS b, '6 | 1:5925585971146611297:1.500000 2:2681491882390849628' AS c,
o_orderkey || ' ' || o_custkey || '| ' AS d, CAST(2681491882390849628 AS BIGINT) AS e, ' | 1:628 2:4 3:4' AS f FROM orders""",
)


# ---- requests

_COLUMNS = ["id", "c1", "c3", "c4", "c5", "c6", "c7", "c8"]
_ASKED = "WITH q AS (SELECT row_number() OVER () AS r, * FROM union_t WHERE epoch_ms(c7) >= 0)"


def _serving(spark: SparkSession, sf: str, statement: str) -> DataFrame:
    """A deployed query answers each row of union_t, repeated ones and those with NULLs included, from the history in udaf_t."""
    s = Session(spark)
    s.register("history", _table(spark, sf, "udaf_t").select(*_COLUMNS))
    s.register("latest", _table(spark, sf, "lastjoin_t2"))
    s.sql(statement)
    return s.request("d", _table(spark, sf, "union_t").select(*_COLUMNS))


@query(
    "deployed_long_window",
    _ASKED
    + f""" SELECT q.id, count(x.c3) + CASE WHEN q.c3 IS NULL THEN 0 ELSE 1 END AS n, CASE WHEN sum(x.c3) IS NULL THEN q.c3 ELSE CAST(sum(x.c3) + coalesce(q.c3, 0) AS INTEGER) END AS s, least(min(x.c3), q.c3) AS a, greatest(max(x.c3), q.c3) AS b,
round((coalesce(sum(x.c3), 0) + coalesce(q.c3, 0)) / nullif(count(x.c3) + CASE WHEN q.c3 IS NULL THEN 0 ELSE 1 END, 0), 6) AS m
FROM q LEFT JOIN udaf_t x ON x.c1 IS NOT DISTINCT FROM q.c1 AND epoch_ms(x.c7) BETWEEN epoch_ms(q.c7) - {480 * HOUR} AND epoch_ms(q.c7) GROUP BY q.r, q.id, q.c3""",
)
def _long(spark: SparkSession, sf: str) -> DataFrame:
    return _serving(spark, sf, "DEPLOY d OPTIONS (LONG_WINDOWS='w:2d') SELECT id, count(c3) OVER w AS n, sum(c3) OVER w AS s, min(c3) OVER w AS a, max(c3) OVER w AS b, round(avg(c3) OVER w, 6) AS m FROM history WINDOW w AS (PARTITION BY c1 ORDER BY c7 ROWS_RANGE BETWEEN 20d PRECEDING AND CURRENT ROW)")


_LATEST = _BEST.replace("c4 DESC NULLS LAST, c3 DESC NULLS LAST, c2 DESC NULLS LAST", "c4 DESC NULLS LAST, c2 DESC NULLS LAST, c3 DESC NULLS LAST")


@query("deployed_last_join", f"{_ASKED.replace(' WHERE epoch_ms(c7) >= 0', '')} SELECT q.id, l.c3 AS r_c3, q.c3 + l.c2 AS s FROM q LEFT JOIN (SELECT *, {_LATEST} FROM lastjoin_t2) l ON l.c1 = q.c1 AND l.k = 1")
def _request_join(spark: SparkSession, sf: str) -> DataFrame:
    return _serving(spark, sf, "DEPLOY d SELECT history.id, latest.c3 AS r_c3, history.c3 + latest.c2 AS s FROM history LAST JOIN latest ORDER BY latest.c4 ON history.c1 = latest.c1")


@query(
    "deployed_window_over_join",
    f"""WITH l AS (SELECT *, {_LATEST} FROM lastjoin_t2), q AS (SELECT row_number() OVER () AS r, u.id, u.c3, u.c7, l.c2 AS v FROM union_t u LEFT JOIN l ON l.c1 = u.c1 AND l.k = 1 WHERE epoch_ms(u.c7) >= 0),
h AS (SELECT u.c3, u.c7, l.c2 AS v FROM udaf_t u LEFT JOIN l ON l.c1 = u.c1 AND l.k = 1 WHERE epoch_ms(u.c7) >= 0)
SELECT q.id, count(h.v) + CASE WHEN q.v IS NULL THEN 0 ELSE 1 END AS n, CASE WHEN sum(h.v) IS NULL THEN q.v ELSE CAST(sum(h.v) + coalesce(q.v, 0) AS INTEGER) END AS s
FROM q LEFT JOIN h ON h.c3 IS NOT DISTINCT FROM q.c3 AND epoch_ms(h.c7) BETWEEN epoch_ms(q.c7) - {480 * HOUR} AND epoch_ms(q.c7) GROUP BY q.r, q.id, q.v""",
)
def _over_join(spark: SparkSession, sf: str) -> DataFrame:
    return _serving(spark, sf, "DEPLOY d SELECT history.id, count(latest.c2) OVER w AS n, sum(latest.c2) OVER w AS s FROM history LAST JOIN latest ORDER BY latest.c4 ON history.c1 = latest.c1 WINDOW w AS (PARTITION BY history.c3 ORDER BY history.c7 ROWS_RANGE BETWEEN 20d PRECEDING AND CURRENT ROW)")


@query("request_in_config", "SELECT CAST(NULL AS VARCHAR) AS c1, count(*) + 1 AS n, CAST(sum(c3) + 5 AS INTEGER) AS s FROM udaf_t WHERE c1 IS NULL AND epoch_ms(c7) BETWEEN 0 AND 4000000000000")
def _config(spark: SparkSession, sf: str) -> DataFrame:
    """A request whose row stands in the query: of an unknown key, after all rows."""
    s = Session(spark)
    s.register("history", _table(spark, sf, "udaf_t").select("id", "c1", "c3", "c7"))
    return s.sql("SELECT c1, count(*) OVER w AS n, sum(c3) OVER w AS s FROM history WINDOW w AS (PARTITION BY c1 ORDER BY c7 ROWS_RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) CONFIG (execute_mode='request', values=(1, NULL, 5, timestamp(4000000000000)))")


@query("statements_more", "SELECT c_custkey, upper(c_name) AS name, c_nationkey + 1 AS n FROM customer UNION ALL SELECT -5, 'NEW', 8 UNION ALL SELECT -6, 'NEW', 8")
def _statements(spark: SparkSession, sf: str) -> DataFrame:
    """Parquet out and in, an index, INSERT OR IGNORE, a table made again from what SHOW CREATE TABLE says, TRUNCATE and ALTER."""
    s = Session(spark, shared_folder(spark, "statements"))
    s.register("customer", _table(spark, sf, "customer"))
    files = shared_folder(spark, "export")
    s.sql("CREATE DATABASE IF NOT EXISTS other")
    s.sql("CREATE TABLE c (c_custkey bigint NOT NULL, c_name string, c_nationkey int DEFAULT 7)")
    s.sql("CREATE INDEX by_key ON c (c_custkey) OPTIONS (ttl=5, ttl_type='latest')")
    s.sql(f"SELECT c_custkey, c_name, c_nationkey FROM customer INTO OUTFILE '{files}' OPTIONS (format='parquet', mode='overwrite')")
    s.sql("INSERT INTO c VALUES (-1, 'gone', 1)")
    s.sql("TRUNCATE TABLE c")
    s.sql(f"ALTER TABLE c ADD OFFLINE_PATH '{files}'")
    made = s.sql("SHOW CREATE TABLE c").first().statement
    s.sql("USE other")
    s.sql(made)
    s.sql("INSERT INTO c (c_custkey, c_name) VALUES (-5, 'new'), (-6, 'new')")
    s.sql("INSERT OR IGNORE INTO c (c_custkey, c_name) VALUES (-6, 'new')")
    return s.sql("SELECT c_custkey, upper(c_name) AS name, c_nationkey + 1 AS n FROM default.c UNION ALL SELECT c_custkey, upper(c_name) AS name, c_nationkey + 1 AS n FROM c")
