"""Queries over the test tables for every operator, written in the dialect or with the API."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.features import Feature, group_features, request_features, window_features
from tidemark.operators.frames import Frame
from tidemark.operators.joins import asof_join, last_join, last_join_where, left_join
from tidemark.operators.preagg import build_buckets, long_window, merge_buckets
from tidemark.operators.ttl import retain
from tidemark.plans.dialect import compile_query
from tidemark.plans.session import Session
from tidemark.storage import shared_folder
from tidemark.streaming.live import live_sessions
from tidemark.streaming.replay import replay
from tidemark.timeutil import DAY_US, floor_div, micros

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def dialect(name: str, text: str, oracle: str | None = None) -> None:
    """A query that is a text of the dialect over the tables of the directory."""
    query(name, oracle)(lambda spark, sf: compile_query(spark, text, lambda n: _table(spark, sf, n[-1])))


# ---- windows: every frame against a join of each row with the rows of its frame

HOUR = 3_600_000
BASE = Frame(["c1"], "c7", tie=["id"])
FEATURES = [("count", "count(x.c3)"), ("sum", "CAST(sum(x.c3) AS INTEGER)"), ("min", "min(x.c3)"), ("max", "max(x.c3)"), ("avg", "round(avg(x.c3), 6)")]


def _api_features(column: str = "c3") -> list[Feature]:
    return [Feature(n, column, alias=f"f_{n}") for n, _ in FEATURES]


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def _frame_sql(inside: str, newest: int | None = None, rows: str = "main", features=FEATURES) -> str:
    """Features of each main row over the rows x of its key that meet ``inside``; with ``newest`` only the last so many."""
    union = "" if rows == "main" else "UNION ALL SELECT id, c1, c3, c7, 0 AS m FROM union_t"
    top = "" if newest is None else f"QUALIFY row_number() OVER (PARTITION BY c.rid ORDER BY x.rn DESC) <= {newest}"
    return f"""WITH a AS (SELECT id, c1, c3, c7, 1 AS m FROM udaf_t {union}), b AS (SELECT *, epoch_ms(c7) AS ms FROM a WHERE epoch_ms(c7) >= 0),
r AS (SELECT *, row_number() OVER (PARTITION BY c1 ORDER BY ms, m, id) AS rn, row_number() OVER () AS rid FROM b),
p AS (SELECT c.rid AS of, x.* FROM r c JOIN r x ON x.c1 IS NOT DISTINCT FROM c.c1 AND ({inside}) WHERE c.m = 1 {top})
SELECT c.id, {", ".join(f"{sql} AS f_{n}" for n, sql in features)} FROM r c LEFT JOIN p x ON x.of = c.rid WHERE c.m = 1 GROUP BY c.rid, c.id"""


def _window(name: str, frame: Frame, inside: str, newest: int | None = None, union: bool = False) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        main = _table(spark, sf, "udaf_t").select("id", "c1", "c3", "c7")
        more = [_table(spark, sf, "union_t").select("id", "c1", "c3", "c7")] if union else []
        return _rounded(window_features(main, [(Frame(**{**frame.__dict__, "unions": more}), _api_features())], ["id"]))

    query(name, _frame_sql(inside, newest, "both" if union else "main"))(run)


_window("window_rows", BASE.rows(3), "x.rn BETWEEN c.rn - 3 AND c.rn")
_window("window_rows_history", BASE.rows(5, 2), "x.rn BETWEEN c.rn - 5 AND c.rn - 2")
_window("window_rows_unbounded", BASE.rows(None), "x.rn <= c.rn")
_window("window_rows_blocks", BASE.rows(3, block_ms=24 * HOUR), "x.rn BETWEEN c.rn - 3 AND c.rn")
_window("window_rows_open", BASE.rows(4, start_open=True), "x.rn BETWEEN c.rn - 3 AND c.rn")
_window("window_range", BASE.rows_range("1d"), f"x.ms >= c.ms - {24 * HOUR} AND x.rn <= c.rn")
_window("window_range_blocks", BASE.rows_range("1d", block_ms=48 * HOUR), f"x.ms >= c.ms - {24 * HOUR} AND x.rn <= c.rn")
_window("window_range_open", BASE.rows_range("1d", start_open=True), f"x.ms > c.ms - {24 * HOUR} AND x.rn <= c.rn")
_window("window_range_unbounded", BASE.rows_range(None), "x.rn <= c.rn")
_window("window_range_history", BASE.rows_range("2d", "3h"), f"x.ms BETWEEN c.ms - {48 * HOUR} AND c.ms - {3 * HOUR}")
_window("window_exclude_current_row", BASE.rows_range("1d", exclude_current_row=True), f"x.ms >= c.ms - {24 * HOUR} AND x.rn < c.rn")
_window("window_rows_exclude_current_row", BASE.rows(3, exclude_current_row=True), "x.rn BETWEEN c.rn - 3 AND c.rn - 1")
_window("window_exclude_current_time", BASE.rows_range("1d", exclude_current_time=True), f"x.ms >= c.ms - {24 * HOUR} AND (x.ms < c.ms OR x.rid = c.rid)")
_window("window_maxsize", BASE.rows_range("3d", maxsize=4), f"x.ms >= c.ms - {72 * HOUR} AND x.rn <= c.rn", 4)
_window("window_maxsize_exclude_current_row", BASE.rows_range("3d", maxsize=4, exclude_current_row=True), f"x.ms >= c.ms - {72 * HOUR} AND x.rn < c.rn", 4)
_window("window_union", BASE.rows_range("2d"), f"x.ms >= c.ms - {48 * HOUR} AND x.rn <= c.rn", union=True)
_window("window_union_rows", BASE.rows(5), "x.rn BETWEEN c.rn - 5 AND c.rn", union=True)
_window("window_instance_not_in_window", BASE.rows_range("2d", instance_not_in_window=True), f"x.ms >= c.ms - {48 * HOUR} AND x.rn <= c.rn AND (x.m = 0 OR x.rid = c.rid)", union=True)
_window("window_instance_not_in_window_maxsize", BASE.rows_range("9d", instance_not_in_window=True, maxsize=3), f"x.ms >= c.ms - {216 * HOUR} AND x.rn <= c.rn AND (x.m = 0 OR x.rid = c.rid)", 3, union=True)


_RANKED = """WITH b AS (SELECT *, epoch_ms(c7) AS ms FROM udaf_t WHERE epoch_ms(c7) >= 0), r AS (SELECT *, row_number() OVER (PARTITION BY c1 ORDER BY ms, id) AS rn, row_number() OVER () AS rid FROM b)"""


@query(
    "window_places",
    _RANKED + """ SELECT id, lag(c3, 2) OVER w AS lag_2, first_value(c3) OVER f AS f_first, last_value(c3) OVER f AS f_last, first_value(c3 IGNORE NULLS) OVER f AS f_first_known
FROM r WINDOW w AS (PARTITION BY c1 ORDER BY rn), f AS (PARTITION BY c1 ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def _places(spark: SparkSession, sf: str) -> DataFrame:
    feats = [Feature("lag", "c3", 2, alias="lag_2"), Feature("first_value", "c3", alias="f_first"), Feature("last_value", "c3", alias="f_last"), Feature("first_value", "c3", True, alias="f_first_known")]
    return window_features(_table(spark, sf, "udaf_t"), [(BASE.rows(4), feats)], ["id"])


@query(
    "window_ordered_aggregates",
    _RANKED + """, p AS (SELECT c.rid AS of, x.rn, x.c3, x.c10, row_number() OVER (PARTITION BY c.rid ORDER BY x.rn DESC) - 1 AS back FROM r c JOIN r x ON x.c1 IS NOT DISTINCT FROM c.c1 AND x.rn BETWEEN c.rn - 5 AND c.rn),
k AS (SELECT *, row_number() OVER (PARTITION BY of ORDER BY rn DESC) - 1 AS i FROM p WHERE c3 IS NOT NULL),
e AS (SELECT of, round(sum(pow(0.5, i) * c3) / sum(pow(0.5, i)), 4) AS f_ew_avg, round(median(c3), 4) AS f_median, round(stddev_samp(c3), 4) AS f_stddev FROM k GROUP BY of),
n AS (SELECT of, c3, row_number() OVER (PARTITION BY of ORDER BY rn) AS j FROM p WHERE c10),
d AS (SELECT a.of, max(CASE WHEN a.c3 > 0 THEN CAST(a.c3 - b.c3 AS DOUBLE) / a.c3 ELSE 0 END) AS x FROM k a JOIN k b ON a.of = b.of AND b.rn >= a.rn WHERE a.c3 >= 0 AND b.c3 >= 0 GROUP BY a.of)
SELECT r.id, f_ew_avg, f_median, f_stddev, n.c3 AS f_second_true, round(d.x, 4) AS f_drawdown FROM r LEFT JOIN e ON e.of = r.rid LEFT JOIN n ON n.of = r.rid AND n.j = 2 LEFT JOIN d ON d.of = r.rid""",
)
def _ordered(spark: SparkSession, sf: str) -> DataFrame:
    feats = [Feature("ew_avg", "c3", 0.5, alias="f_ew_avg"), Feature("median", "c3", alias="f_median"), Feature("stddev", "c3", alias="f_stddev"), Feature("nth_value_where", "c3", 2, "c10", alias="f_second_true"), Feature("drawdown", "c3", alias="f_drawdown")]
    out = window_features(_table(spark, sf, "udaf_t"), [(BASE.rows(5), feats)], ["id"])
    return out.withColumns({c: F.round(c, 4) for c in ("f_ew_avg", "f_median", "f_stddev", "f_drawdown")})


@query(
    "window_categories",
    _RANKED + """, p AS (SELECT c.rid AS of, x.c3, x.c9, x.c10 FROM r c JOIN r x ON x.c1 IS NOT DISTINCT FROM c.c1 AND x.rn BETWEEN c.rn - 6 AND c.rn WHERE x.c9 IS NOT NULL AND x.c3 IS NOT NULL),
g AS (SELECT of, c9, count(*) AS n, sum(c3) AS s, count(*) FILTER (WHERE c10) AS nw, max(c3) FILTER (WHERE c10) AS mw FROM p GROUP BY of, c9),
t AS (SELECT of, string_agg(c9 || ':' || n, ',' ORDER BY encode(c9)) AS f_count, string_agg(c9 || ':' || s, ',' ORDER BY encode(c9)) AS f_sum,
string_agg(c9 || ':' || nw, ',' ORDER BY encode(c9)) FILTER (WHERE nw > 0) AS f_count_where FROM g GROUP BY of),
o AS (SELECT of, c9, mw, row_number() OVER (PARTITION BY of ORDER BY encode(c9) DESC) AS k, row_number() OVER (PARTITION BY of ORDER BY mw DESC, encode(c9) DESC) AS v FROM g WHERE nw > 0),
u AS (SELECT of, string_agg(c9 || ':' || mw, ',' ORDER BY k) FILTER (WHERE k <= 2) AS f_top_key, string_agg(c9 || ':' || mw, ',' ORDER BY v) FILTER (WHERE v <= 2) AS f_top_value FROM o GROUP BY of)
SELECT r.id, coalesce(f_count, '') AS f_count, coalesce(f_sum, '') AS f_sum, coalesce(f_count_where, '') AS f_count_where, coalesce(f_top_key, '') AS f_top_key, coalesce(f_top_value, '') AS f_top_value
FROM r LEFT JOIN t ON t.of = r.rid LEFT JOIN u ON u.of = r.rid""",
)
def _window_categories(spark: SparkSession, sf: str) -> DataFrame:
    feats = [Feature("count_cate", "c3", "c9", alias="f_count"), Feature("sum_cate", "c3", "c9", alias="f_sum"), Feature("count_cate_where", "c3", "c10", "c9", alias="f_count_where"), Feature("top_n_key_max_cate_where", "c3", "c10", "c9", 2, alias="f_top_key"), Feature("top_n_value_max_cate_where", "c3", "c10", "c9", 2, alias="f_top_value")]
    return window_features(_table(spark, sf, "udaf_t"), [(BASE.rows(6), feats)], ["id"])


@query(
    "window_split",
    _RANKED + """, p AS (SELECT c.rid AS of, x.c9, x.rn FROM r c JOIN r x ON x.c1 IS NOT DISTINCT FROM c.c1 AND x.rn BETWEEN c.rn - 2 AND c.rn WHERE x.c9 IS NOT NULL),
s AS (SELECT of, string_agg(array_to_string(string_split(c9, 'a'), '|'), '|' ORDER BY rn DESC) AS f_parts FROM p GROUP BY of) SELECT r.id, coalesce(f_parts, '') AS f_parts FROM r LEFT JOIN s ON s.of = r.rid""",
)
def _window_split(spark: SparkSession, sf: str) -> DataFrame:
    out = window_features(_table(spark, sf, "udaf_t"), [(BASE.rows(2), [Feature("window_split", "c9", "a", alias="parts")])], ["id"])
    return out.select("id", F.array_join("parts", "|").alias("f_parts"))


@query(
    "window_top",
    _RANKED + """, p AS (SELECT c.rid AS of, x.c3, x.c9 FROM r c JOIN r x ON x.c1 IS NOT DISTINCT FROM c.c1 AND x.rn BETWEEN c.rn - 6 AND c.rn),
q AS (SELECT *, row_number() OVER (PARTITION BY of ORDER BY c3 DESC) AS k FROM p WHERE c3 IS NOT NULL),
ta AS (SELECT of, string_agg(CAST(c3 AS VARCHAR), ',' ORDER BY k) AS f_top FROM q WHERE k <= 3 GROUP BY of),
g AS (SELECT of, c9, count(*) AS n, row_number() OVER (PARTITION BY of ORDER BY count(*) DESC, encode(c9)) AS k FROM p WHERE c9 IS NOT NULL GROUP BY of, c9),
tb AS (SELECT of, string_agg(c9, ',' ORDER BY k) FILTER (WHERE k <= 2) || repeat(',NULL', CAST(greatest(2 - count(*), 0) AS BIGINT)) AS f_frequent, round(CAST(max(n) AS DOUBLE) / sum(n), 6) AS f_ratio,
count(*) AS f_kinds FROM g GROUP BY of),
h AS (SELECT of, round(-sum(n / t * log2(n / t)) + 0.0, 6) AS f_entropy FROM (SELECT of, CAST(n AS DOUBLE) AS n, sum(n) OVER (PARTITION BY of) AS t FROM g) z GROUP BY of)
SELECT r.id, coalesce(f_top, '') AS f_top, coalesce(f_frequent, 'NULL,NULL') AS f_frequent, coalesce(f_ratio, 0.0) AS f_ratio, f_entropy FROM r LEFT JOIN ta ON ta.of = r.rid LEFT JOIN tb ON tb.of = r.rid LEFT JOIN h ON h.of = r.rid""",
)
def _window_top(spark: SparkSession, sf: str) -> DataFrame:
    feats = [Feature("top", "c3", 3, alias="f_top"), Feature("topn_frequency", "c9", 2, alias="f_frequent"), Feature("top1_ratio", "c9", alias="f_ratio"), Feature("entropy", "c9", alias="f_entropy")]
    out = window_features(_table(spark, sf, "udaf_t"), [(BASE.rows(6), feats)], ["id"])
    return out.withColumns({c: F.round(F.col(c) + 0.0, 6) for c in ("f_ratio", "f_entropy")})


# ---- statements, files and streams

_WEEK_US = 7 * DAY_US

@query("statements", "SELECT c_custkey, c_name, c_nationkey + 1 AS next FROM customer WHERE c_nationkey <> 3 AND c_custkey % 7 <> 0 UNION ALL SELECT -1, 'added', 6 UNION ALL SELECT -2, 'default', 1")
def _statements(spark: SparkSession, sf: str) -> DataFrame:
    s = Session(spark, shared_folder(spark, "statements"))
    s.register("customer", _table(spark, sf, "customer"))
    files = shared_folder(spark, "export")
    s.sql("CREATE TABLE c (c_custkey bigint NOT NULL, c_name string DEFAULT 'default', c_nationkey int DEFAULT 0)")
    s.sql(f"SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey != 3 INTO OUTFILE '{files}' OPTIONS (format='csv', mode='overwrite')")
    s.sql(f"LOAD DATA INFILE '{files}' INTO TABLE c OPTIONS (format='csv', mode='append')")
    s.sql("INSERT INTO c VALUES (-1, 'added', 5)")
    s.sql("INSERT INTO c (c_custkey) VALUES (-2)")
    s.sql("DELETE FROM c WHERE c_custkey % 7 = 0")
    return s.sql("SELECT c_custkey, c_name, c_nationkey + 1 AS next FROM c")


@query(
    "stream_sessions",
    """WITH k AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM k)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS events FROM s GROUP BY user_id, s""",
)
def _stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of a stream in append mode: each is given out when its timer has run out, six hours after its last event."""
    rows = _table(spark, sf, "events")
    rows = rows.select("user_id", F.timestamp_micros(micros(rows, "ts")).alias("at"))

    def last(number: int) -> DataFrame:
        return spark.range(1).select(F.lit(-1).alias("user_id"), F.timestamp_micros(F.lit((number + 2) * _WEEK_US)).alias("at"))

    found = replay(rows, floor_div(F.unix_micros("at"), _WEEK_US), lambda stream: live_sessions(stream, ["user_id"], "at", "6 hours", "1 day"), last)
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


# ---- groups

dialect(
    "group_by",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_orderkey) AS s, min(l_shipdate) AS first, max(l_quantity) AS top FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS s, min(l_shipdate) AS first, max(l_quantity) AS top FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
dialect(
    "group_having",
    "SELECT c1, count(c3) AS n, sum(c4) AS s FROM udaf_t GROUP BY c1 HAVING count(c3) > 3 AND sum(c4) > 100",
    "SELECT c1, count(c3) AS n, CAST(sum(c4) AS BIGINT) AS s FROM udaf_t GROUP BY c1 HAVING count(c3) > 3 AND sum(c4) > 100",
)
dialect(
    "table_aggregate",
    "SELECT count(*) AS n, count(l1) AS k, sum(l2) AS s, min(ts) AS first, max(ts) AS last, avg(l1) + 0 AS a FROM null_agg",
    "SELECT count(*) AS n, count(l1) AS k, CAST(sum(l2) AS BIGINT) AS s, min(ts) AS first, max(ts) AS last, avg(l1) AS a FROM null_agg",
)
dialect(
    "group_where",
    "SELECT key1, count_where(l1, l2 > 3) AS n, sum_where(l1, l2 > 3) AS s, min_where(l1, l2 > 3) AS a, max_where(l1, l2 > 3) AS b, round(avg_where(l1, l2 > 3), 6) AS m FROM null_agg GROUP BY key1",
    "SELECT key1, count(l1) FILTER (WHERE l2 > 3) AS n, CAST(sum(l1) FILTER (WHERE l2 > 3) AS BIGINT) AS s, min(l1) FILTER (WHERE l2 > 3) AS a, max(l1) FILTER (WHERE l2 > 3) AS b, round(avg(l1) FILTER (WHERE l2 > 3), 6) AS m FROM null_agg GROUP BY key1",
)
dialect(
    "group_statistics",
    "SELECT c1, round(median(c3), 6) AS med, round(stddev(c3), 4) AS sd, round(var_pop(c3), 4) AS vp, round(stddev_pop(c3), 4) AS sp, round(var_samp(c3), 4) AS vs, distinct_count(c3) AS d FROM udaf_t GROUP BY c1",
    "SELECT c1, round(median(c3), 6) AS med, round(stddev_samp(c3), 4) AS sd, round(var_pop(c3), 4) AS vp, round(stddev_pop(c3), 4) AS sp, round(var_samp(c3), 4) AS vs, count(DISTINCT coalesce(c3, 0)) AS d FROM udaf_t GROUP BY c1",
)


dialect(
    "group_tallies",
    "SELECT c1, round(entropy(c9) + 0, 6) AS e, round(top1_ratio(c9), 6) AS r, top(c3, 3) AS t, topn_frequency(c9, 3) AS f FROM udaf_t GROUP BY c1",
    """WITH n AS (SELECT c1, c9, CAST(count(*) AS DOUBLE) AS n, sum(count(*)) OVER (PARTITION BY c1) AS t, row_number() OVER (PARTITION BY c1 ORDER BY count(*) DESC, encode(c9)) AS k FROM udaf_t WHERE c9 IS NOT NULL GROUP BY c1, c9),
a AS (SELECT c1, round(-sum(n / t * log2(n / t)) + 0.0, 6) AS e, round(max(n) / max(t), 6) AS r, string_agg(c9, ',' ORDER BY k) FILTER (WHERE k <= 3) || repeat(',NULL', CAST(greatest(3 - count(*), 0) AS BIGINT)) AS f FROM n GROUP BY c1),
q AS (SELECT c1, c3, row_number() OVER (PARTITION BY c1 ORDER BY c3 DESC) AS k FROM udaf_t WHERE c3 IS NOT NULL), b AS (SELECT c1, string_agg(CAST(c3 AS VARCHAR), ',' ORDER BY k) AS t FROM q WHERE k <= 3 GROUP BY c1)
SELECT g.c1, a.e, coalesce(a.r, 0.0) AS r, coalesce(b.t, '') AS t, coalesce(a.f, 'NULL,NULL,NULL') AS f FROM (SELECT DISTINCT c1 FROM udaf_t) g LEFT JOIN a ON a.c1 IS NOT DISTINCT FROM g.c1 LEFT JOIN b ON b.c1 IS NOT DISTINCT FROM g.c1""",
)


@query(
    "group_categories",
    """WITH g AS (SELECT event_type, user_id, count(*) AS n, max(event_id) AS m, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS q FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL GROUP BY 1, 2),
w AS (SELECT event_type, user_id, count(*) AS n FROM events WHERE value > 50 GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id DESC) AS v, row_number() OVER (PARTITION BY event_type ORDER BY user_id DESC) AS k FROM w),
q AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY user_id DESC) AS k FROM g)
SELECT e.event_type, (SELECT string_agg(user_id || ':' || n, ',' ORDER BY user_id) FROM g WHERE g.event_type = e.event_type) AS f_count, (SELECT string_agg(user_id || ':' || m, ',' ORDER BY user_id) FROM g WHERE g.event_type = e.event_type) AS f_max,
(SELECT string_agg(user_id || ':' || n, ',' ORDER BY v) FROM o WHERE o.event_type = e.event_type AND v <= 3) AS f_top_value, (SELECT string_agg(user_id || ':' || n, ',' ORDER BY k) FROM o WHERE o.event_type = e.event_type AND k <= 3) AS f_top_key,
(SELECT string_agg(user_id || ':' || printf('%.6f', q), ',' ORDER BY k) FROM q WHERE q.event_type = e.event_type AND k <= 4) AS f_ratio
FROM (SELECT DISTINCT event_type FROM events) e""",
)
def _group_categories(spark: SparkSession, sf: str) -> DataFrame:
    events = _table(spark, sf, "events")
    feats = [Feature("count_cate", "value", "user_id", alias="f_count"), Feature("max_cate", "event_id", "user_id", alias="f_max"), Feature("top_n_value_count_cate_where", "value", F.col("value") > 50, "user_id", 3, alias="f_top_value"), Feature("top_n_key_count_cate_where", "value", F.col("value") > 50, "user_id", 3, alias="f_top_key"), Feature("top_n_key_ratio_cate", "value", F.col("value") > 20, "user_id", 4, alias="f_ratio")]
    return group_features(events, ["event_type"], feats)


# ---- joins

_BEST = "row_number() OVER (PARTITION BY c1 ORDER BY c4 DESC NULLS LAST, c3 DESC NULLS LAST, c2 DESC NULLS LAST) AS k"


@query("last_join", f"SELECT l.id, l.c1, r.c2 AS r_c2, r.c3 AS r_c3, r.c4 AS r_c4 FROM udaf_t l LEFT JOIN (SELECT *, {_BEST} FROM lastjoin_t2) r ON r.c1 = l.c1 AND r.k = 1")
def _last_join(spark: SparkSession, sf: str) -> DataFrame:
    right = _table(spark, sf, "lastjoin_t2").select("c1", *[F.col(c).alias(f"r_{c}") for c in ("c2", "c3", "c4")])
    return last_join(_table(spark, sf, "udaf_t").select("id", "c1"), right, ["c1"], "r_c4", ["r_c3", "r_c2"], columns=["r_c2", "r_c3", "r_c4"])


@query("last_join_where", f"SELECT l.id, r.c3 AS r_c3 FROM udaf_t l LEFT JOIN (SELECT *, {_BEST} FROM lastjoin_t2 WHERE c2 > 40) r ON r.c1 = l.c1 AND r.k = 1")
def _last_join_right(spark: SparkSession, sf: str) -> DataFrame:
    right = _table(spark, sf, "lastjoin_t2")
    out = last_join(_table(spark, sf, "udaf_t").select("id", "c1"), right, ["c1"], "c4", ["c3", "c2"], where=F.col("c2") > 40, columns=["c3"])
    return out.select("id", F.col("c3").alias("r_c3"))


_ASOF = """WITH l AS (SELECT id, c1, c7, row_number() OVER () AS rid FROM udaf_t), p AS (SELECT l.rid, r.c3, r.c4, row_number() OVER (PARTITION BY l.rid ORDER BY r.c4 DESC, r.c3 DESC, r.c2 DESC) AS k FROM l JOIN lastjoin_t2 r ON r.c1 = l.c1 AND r.c4 <= l.c7)
SELECT l.id, p.c3 AS r_c3, p.c4 AS r_c4 FROM l LEFT JOIN p ON p.rid = l.rid AND p.k = 1"""


@query("asof_join", _ASOF)
def _asof(spark: SparkSession, sf: str) -> DataFrame:
    right = _table(spark, sf, "lastjoin_t2").select("c1", F.col("c2").alias("r_c2"), F.col("c3").alias("r_c3"), F.col("c4").alias("r_c4"))
    return asof_join(_table(spark, sf, "udaf_t").select("id", "c1", "c7"), right, ["c1"], "c7", "r_c4", ["r_c3", "r_c2"], columns=["r_c3", "r_c4"]).drop("c1", "c7")


dialect("dialect_asof", "SELECT a.id, max_c3 AS r_c3, b.c4 AS r_c4 FROM udaf_t AS a LAST JOIN (SELECT c1, c4, max(c3) AS max_c3 FROM lastjoin_t2 GROUP BY c1, c4) AS b ORDER BY b.c4 ON a.c1 = b.c1 AND b.c4 <= a.c7", _ASOF)


@query("last_join_any_condition", _ASOF)
def _theta(spark: SparkSession, sf: str) -> DataFrame:
    right = _table(spark, sf, "lastjoin_t2").select("c1", F.col("c2").alias("r_c2"), F.col("c3").alias("r_c3"), F.col("c4").alias("r_c4"))
    return last_join_where(_table(spark, sf, "udaf_t").select("id", "c1", "c7"), right, ["c1"], "r.r_c4 <= l.c7", "r_c4", ["r_c3", "r_c2"], columns=["r_c3", "r_c4"]).drop("c1", "c7")


@query("left_join", "SELECT a.col1, a.col5, a.col0, b.str0, b.col3 AS r_col3 FROM simple_t1 a LEFT JOIN simple_t2 b ON a.col1 = b.col1 AND a.col5 = b.col5")
def _left(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _table(spark, sf, "simple_t1").select("col1", "col5", "col0"), _table(spark, sf, "simple_t2")
    return left_join(a, b, ["col1", "col5"], columns=["str0", "col3"]).withColumnRenamed("col3", "r_col3")


dialect(
    "last_join_of_orders",
    "SELECT c.c_custkey, o.o_orderkey FROM customer AS c LAST JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey) AS o ORDER BY o.o_orderkey ON c.c_custkey = o.o_custkey",
    "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 1000) AS o_orderkey FROM customer",
)


dialect(
    "last_join_chain",
    "SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM orders AS o LAST JOIN customer AS c ORDER BY c.c_custkey ON o.o_custkey = c.c_custkey LAST JOIN nation AS n ORDER BY n.n_nationkey ON c.c_nationkey = n.n_nationkey LEFT JOIN region AS r ON n.n_regionkey = r.r_regionkey AND r.r_regionkey > 0 WHERE o.o_totalprice > 1000",
    "SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_regionkey > 0 WHERE o.o_totalprice > 1000",
)
dialect(
    "group_over_join",
    "SELECT n.n_name, count(*) AS k, round(avg(c.c_acctbal), 6) AS a, min(c.c_name) AS first FROM customer AS c LEFT JOIN nation AS n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name HAVING count(*) > 1",
    "SELECT n.n_name, count(*) AS k, round(avg(c.c_acctbal), 6) AS a, min(c.c_name) AS first FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name HAVING count(*) > 1",
)
dialect(
    "window_over_union",
    "SELECT id, sum(c3) OVER w AS s, count(*) OVER w AS n FROM (SELECT id, c1, c3, c7 FROM udaf_t UNION DISTINCT SELECT id, c1, c3, c7 FROM union_t) AS u WINDOW w AS (PARTITION BY c1 ORDER BY c7 ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
    """WITH u AS (SELECT id, c1, c3, c7 FROM udaf_t UNION SELECT id, c1, c3, c7 FROM union_t) SELECT id, CAST(sum(c3) OVER w AS INTEGER) AS s, count(*) OVER w AS n FROM u WHERE epoch_ms(c7) >= 0
WINDOW w AS (PARTITION BY c1 ORDER BY epoch_ms(c7), id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
dialect(
    "last_join_of_a_window",
    """SELECT l.c1, l.c3, t.id, t.n FROM lastjoin_t2 AS l LAST JOIN (SELECT id, c1, count(c3) OVER w AS n FROM udaf_t WINDOW w AS (PARTITION BY c1 ORDER BY c7 ROWS_RANGE BETWEEN 5d PRECEDING AND CURRENT ROW)) AS t ORDER BY t.id ON l.c1 = t.c1""",
    _RANKED
    + f""", p AS (SELECT c.id, c.c1, c.rid, count(x.c3) AS n FROM r c LEFT JOIN r x ON x.c1 IS NOT DISTINCT FROM c.c1 AND x.rn <= c.rn AND x.ms >= c.ms - {120 * HOUR} GROUP BY c.id, c.c1, c.rid), k AS (SELECT *, row_number() OVER (PARTITION BY c1 ORDER BY id DESC, n DESC) AS k FROM p)
SELECT l.c1, l.c3, k.id, k.n FROM lastjoin_t2 l LEFT JOIN k ON k.c1 = l.c1 AND k.k = 1""",
)


@query(
    "window_over_last_join",
    f"""WITH j AS (SELECT l.id, l.c1, l.c7, r.c3 AS v FROM udaf_t l LEFT JOIN (SELECT *, {_BEST} FROM lastjoin_t2) r ON r.c1 = l.c1 AND r.k = 1 WHERE l.c7 IS NOT NULL AND epoch_ms(l.c7) >= 0)
SELECT id, CAST(sum(v) OVER (PARTITION BY c1 ORDER BY c7, id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM j""",
)
def _over_join(spark: SparkSession, sf: str) -> DataFrame:
    right = _table(spark, sf, "lastjoin_t2").select("c1", F.col("c2").alias("r_c2"), F.col("c3").alias("v"), F.col("c4").alias("r_c4"))
    joined = last_join(_table(spark, sf, "udaf_t").select("id", "c1", "c7"), right, ["c1"], "r_c4", ["v", "r_c2"], columns=["v"])
    return window_features(joined, [(BASE.rows(3), [Feature("sum", "v", alias="s")])], ["id"])


# ---- rows: projections, conditions, set operations

dialect(
    "expressions",
    """SELECT l_orderkey, l_linenumber, l_quantity / 0 AS inf, l_linenumber DIV 2 AS d, l_linenumber % 0 AS z, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS k,
NOT (l_linenumber > 3) AS n, l_linenumber IN (1, 2) AS i, l_linenumber BETWEEN 2 AND 4 AS b, l_returnflag LIKE 'A%' AS a, l_linenumber & 3 AS band, l_linenumber | 8 AS bor, l_linenumber ^ 5 AS bxor, (l_linenumber > 2) XOR (l_linenumber > 4) AS x FROM lineitem""",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 0 THEN CAST('nan' AS DOUBLE) WHEN l_quantity > 0 THEN CAST('inf' AS DOUBLE) ELSE CAST('-inf' AS DOUBLE) END AS inf, l_linenumber // 2 AS d, CAST(NULL AS INTEGER) AS z, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS k,
NOT (l_linenumber > 3) AS n, l_linenumber IN (1, 2) AS i, l_linenumber BETWEEN 2 AND 4 AS b, l_returnflag LIKE 'A%' AS a, l_linenumber & 3 AS band, l_linenumber | 8 AS bor, xor(l_linenumber, 5) AS bxor, (l_linenumber > 2) <> (l_linenumber > 4) AS x FROM lineitem""",
)
dialect("filter", "SELECT id, c1 FROM udaf_t WHERE c3 > 100 AND (c10 IS NULL OR NOT c10) AND c1 IS NOT NULL", "SELECT id, c1 FROM udaf_t WHERE c3 > 100 AND (c10 IS NULL OR NOT c10) AND c1 IS NOT NULL")
dialect("constant", "SELECT 1 AS a, 'x' AS b, 1.5 AS c, true AS d, 10000000000 AS e", "SELECT 1 AS a, 'x' AS b, CAST(1.5 AS DOUBLE) AS c, true AS d, 10000000000 AS e")
dialect("distinct", "SELECT DISTINCT c1, c9 FROM udaf_t", "SELECT DISTINCT c1, c9 FROM udaf_t")
dialect("sort_limit", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 20", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 20")
dialect("union_all", "SELECT id, c1 FROM udaf_t UNION ALL SELECT id, c1 FROM union_t", "SELECT id, c1 FROM udaf_t UNION ALL SELECT id, c1 FROM union_t")
dialect("union_distinct", "SELECT c1, c3 FROM udaf_t UNION DISTINCT SELECT c1, c3 FROM union_t", "SELECT c1, c3 FROM udaf_t UNION SELECT c1, c3 FROM union_t")
dialect(
    "with_and_subquery",
    "WITH a AS (SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey < 3), b AS (SELECT n_regionkey, count(*) AS n FROM a GROUP BY n_regionkey) SELECT t.n_regionkey, t.n + 1 AS m FROM (SELECT * FROM b) AS t",
    "WITH a AS (SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey < 3), b AS (SELECT n_regionkey, count(*) AS n FROM a GROUP BY n_regionkey) SELECT t.n_regionkey, t.n + 1 AS m FROM (SELECT * FROM b) AS t",
)

# ---- scalar functions

dialect(
    "functions_string",
    """SELECT c_custkey, concat(c_name, '/', c_custkey) AS a, concat_ws('-', c_name, c_mktsegment) AS b, substr(c_name, 3, 4) AS c, substr(c_name, -3) AS d, substr(c_name, 0) AS e, locate('0', c_name) AS f, strcmp(c_name, 'Customer#000000050') AS g,
ucase(c_mktsegment) AS h, lcase(c_mktsegment) AS i, reverse(c_name) AS j, char_length(c_name) AS k, replace(c_name, '0', 'o') AS l, like_match(c_name, '%1_') AS m, ilike_match(c_mktsegment, 'b%') AS n, regexp_like(c_name, '.*[13579]') AS o, hex(c_custkey) AS p FROM customer""",
    """SELECT c_custkey, c_name || '/' || c_custkey AS a, c_name || '-' || c_mktsegment AS b, substr(c_name, 3, 4) AS c, right(c_name, 3) AS d, '' AS e, CAST(instr(c_name, '0') AS INTEGER) AS f, CASE WHEN c_name < 'Customer#000000050' THEN -1 WHEN c_name > 'Customer#000000050' THEN 1 ELSE 0 END AS g,
upper(c_mktsegment) AS h, lower(c_mktsegment) AS i, reverse(c_name) AS j, CAST(strlen(c_name) AS INTEGER) AS k, replace(c_name, '0', 'o') AS l, c_name LIKE '%1_' AS m, c_mktsegment ILIKE 'b%' AS n, regexp_full_match(c_name, '.*[13579]') AS o, upper(printf('%x', c_custkey)) AS p FROM customer""",
)
dialect(
    "functions_math",
    """SELECT o_orderkey, round(log(o_totalprice), 6) AS a, round(log2(o_totalprice), 6) AS b, round(log10(o_totalprice), 6) AS c, abs(1 - o_orderkey) AS d, ceil(o_totalprice) AS e, floor(o_totalprice) AS f, round(sqrt(o_totalprice), 6) AS g, round(pow(o_orderkey, 2), 3) AS h,
round(sin(o_orderkey), 6) AS i, round(cos(o_orderkey), 6) AS j, round(atan(o_orderkey), 6) AS k, round(degrees(o_orderkey), 4) AS l, truncate(0 - o_totalprice) AS m, pmod(o_orderkey, 7) AS n, pmod(o_orderkey, 0) AS o, maximum(o_orderkey, o_custkey) AS p, minimum(o_orderkey, o_custkey) AS q, inc(o_orderkey) AS r FROM orders""",
    """SELECT o_orderkey, round(ln(o_totalprice), 6) AS a, round(log2(o_totalprice), 6) AS b, round(log10(o_totalprice), 6) AS c, abs(1 - o_orderkey) AS d, CAST(ceil(o_totalprice) AS BIGINT) AS e, CAST(floor(o_totalprice) AS BIGINT) AS f, round(sqrt(o_totalprice), 6) AS g, round(pow(o_orderkey, 2), 3) AS h,
round(sin(o_orderkey), 6) AS i, round(cos(o_orderkey), 6) AS j, round(atan(o_orderkey), 6) AS k, round(degrees(o_orderkey), 4) AS l, CAST(-floor(o_totalprice) AS BIGINT) AS m, o_orderkey % 7 AS n, CAST(NULL AS BIGINT) AS o, greatest(o_orderkey, o_custkey) AS p, least(o_orderkey, o_custkey) AS q, o_orderkey + 1 AS r FROM orders""",
)
dialect(
    "functions_time",
    "SELECT event_id, year(ts) AS a, month(ts) AS b, dayofmonth(ts) AS c, dayofweek(ts) AS d, dayofyear(ts) AS e, weekofyear(ts) AS f, hour(ts) AS g, minute(ts) AS h, second(ts) AS i, date_format(ts, '%Y-%m-%d %H:%M:%S') AS j, datediff(date(ts), '2023-12-25') AS k, unix_timestamp(ts) AS l, string(last_day(ts)) AS m, string(add_months(date(ts), 1)) AS n FROM events",
    "SELECT event_id, CAST(year(ts) AS INTEGER) AS a, CAST(month(ts) AS INTEGER) AS b, CAST(day(ts) AS INTEGER) AS c, CAST(dayofweek(ts) + 1 AS INTEGER) AS d, CAST(dayofyear(ts) AS INTEGER) AS e, CAST(weekofyear(ts) AS INTEGER) AS f, CAST(hour(ts) AS INTEGER) AS g, CAST(minute(ts) AS INTEGER) AS h, CAST(second(ts) AS INTEGER) AS i, strftime(ts, '%Y-%m-%d %H:%M:%S') AS j, CAST(date_diff('day', DATE '2023-12-25', CAST(ts AS DATE)) AS INTEGER) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS l, strftime(last_day(ts), '%Y-%m-%d') AS m, strftime(CAST(ts AS DATE) + INTERVAL 1 MONTH, '%Y-%m-%d') AS n FROM events",
)
dialect(
    "functions_cast_null",
    "SELECT c_custkey, int(substr(c_name, 10)) AS a, bigint('x') AS b, double(c_custkey) AS c, smallint(c_custkey % 100) AS d, bool('YES') AS e, string(c_custkey) AS f, if_null(bigint('x'), c_custkey) AS g, nvl2(bigint('x'), 1, 2) AS h, is_null(bigint('x')) AS i, CAST(c_acctbal AS bigint) AS j FROM customer",
    "SELECT c_custkey, CAST(substr(c_name, 10) AS INTEGER) AS a, CAST(NULL AS BIGINT) AS b, CAST(c_custkey AS DOUBLE) AS c, CAST(c_custkey % 100 AS SMALLINT) AS d, true AS e, CAST(c_custkey AS VARCHAR) AS f, c_custkey AS g, 2 AS h, true AS i, CAST(trunc(c_acctbal) AS BIGINT) AS j FROM customer",
)
dialect(
    "functions_json_array",
    "SELECT event_id, get_json_object(props, '/k') AS a, json_array_length('[1,2,3]') AS b, array_join(split_array(event_type, 'i'), '+') AS c, join(split(event_type, 'c'), '|') AS d, array_contains(['view', 'click'], event_type) AS e, map('a', event_id)['a'] AS f, array_join(array_combine('-', ['1', '2'], ['3', '4']), ',') AS g, size(split(event_type, 'i')) AS h, join(split_by_key('a:1,b,c:3', ',', ':'), ' ') AS i, join(list_except_by_key(split('a:1,b:2', ','), 'a'), ' ') AS j FROM events",
    "SELECT event_id, json_extract_string(props, '$.k') AS a, 3 AS b, array_to_string(string_split(event_type, 'i'), '+') AS c, array_to_string(string_split(event_type, 'c'), '|') AS d, event_type IN ('view', 'click') AS e, event_id AS f, '1-3,1-4,2-3,2-4' AS g, CAST(len(string_split(event_type, 'i')) AS INTEGER) AS h, 'a c' AS i, 'b:2' AS j FROM events",
)
dialect(
    "functions_math_more",
    """SELECT c_custkey, round(log(2, c_custkey + 1), 6) AS a, round(acos((c_custkey % 2000) / 2000), 6) AS b, round(asin((c_custkey % 2000) / 2000), 6) AS c, round(tan(c_custkey), 3) AS d, round(cot(c_custkey + 1), 3) AS e, round(atan2(c_custkey, 7), 6) AS f, round(atan(c_custkey, 7), 6) AS g, round(radians(c_custkey), 6) AS h,
round(exp((c_custkey % 2000) / 1000), 6) AS i, round(ln(c_custkey + 1), 6) AS j, add(c_custkey, 5) AS k, identity(c_custkey) AS l, round(c_acctbal, 1) AS m, c_custkey + 1 - 2 * 3 AS n, 0 - c_custkey AS o FROM customer""",
    """SELECT c_custkey, round(ln(c_custkey + 1) / ln(2), 6) AS a, round(acos((c_custkey % 2000) / 2000), 6) AS b, round(asin((c_custkey % 2000) / 2000), 6) AS c, round(tan(c_custkey), 3) AS d, round(1 / tan(c_custkey + 1), 3) AS e, round(atan2(c_custkey, 7), 6) AS f, round(atan2(c_custkey, 7), 6) AS g, round(radians(c_custkey), 6) AS h,
round(exp((c_custkey % 2000) / 1000), 6) AS i, round(ln(c_custkey + 1), 6) AS j, c_custkey + 5 AS k, c_custkey AS l, round(c_acctbal, 1) AS m, c_custkey + 1 - 2 * 3 AS n, 0 - c_custkey AS o FROM customer""",
)
dialect(
    "functions_convert",
    """SELECT c_custkey, char(65 + c_custkey % 26) AS a, unhex(hex(c_name)) AS b, nvl(int('x'), 7) AS c, ifnull(c_mktsegment, 'none') AS d, datediff('2020-03-01', '2020-02-01') AS e, unix_timestamp(timestamp(c_custkey * 86400000)) AS f, string(date('2020-02-29')) AS g, is_null(date('2020-02-30')) AS h, isin(c_nationkey, [1, 2, 3]) AS i,
join(list_except_by_value(split('a:1,b:2', ','), '2'), ' ') AS j, join(split_by_value('a:1,b,c:3', ',', ':'), ' ') AS k, array_join(map_keys(map('x', 1, 'y', 2)), '+') AS l, make_tuple(c_custkey, 'q') = make_tuple(c_custkey, 'q') AS m, string(true) AS n, float('1.5') AS o, hex(17.6) AS p, character_length(c_name) AS q, substring(c_name, 1, 3) AS r, float('z') IS NULL AS s FROM customer""",
    """SELECT c_custkey, chr(CAST(65 + c_custkey % 26 AS INTEGER)) AS a, c_name AS b, 7 AS c, coalesce(c_mktsegment, 'none') AS d, 29 AS e, c_custkey * 86400 AS f, '2020-02-29' AS g, true AS h, c_nationkey IN (1, 2, 3) AS i,
'a:1' AS j, '1 3' AS k, 'x+y' AS l, true AS m, 'true' AS n, CAST(1.5 AS FLOAT) AS o, '12' AS p, CAST(strlen(c_name) AS INTEGER) AS q, substr(c_name, 1, 3) AS r, true AS s FROM customer""",
)
dialect("functions_distance", "SELECT c_custkey, round(earth_distance(c_custkey % 80, 10, 40, c_custkey % 90), 3) AS km FROM customer", "SELECT c_custkey, round(2 * 6372.8 * asin(sqrt(pow(sin((radians(40) - radians(c_custkey % 80)) / 2), 2) + cos(radians(c_custkey % 80)) * cos(radians(40)) * pow(sin((radians(c_custkey % 90) - radians(10)) / 2), 2))), 3) AS km FROM customer")
dialect(
    "sample_lines",
    "SELECT o_orderkey, csv(multiclass_label(o_custkey), continuous(o_orderkey), continuous(o_custkey)) AS a, libsvm(binary_label(o_orderkey % 2 = 0), continuous(o_orderkey), continuous(o_custkey)) AS b FROM orders",
    "SELECT o_orderkey, o_custkey || ',' || o_orderkey || ',' || o_custkey AS a, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END || ' 1:' || o_orderkey || ' 2:' || o_custkey AS b FROM orders",
)
# published fingerprints of three strings and of slot numbers: fixed values
dialect(
    "sample_lines_hashed",
    """SELECT o_orderkey, hash64(CASE o_orderkey % 3 WHEN 0 THEN '1footrue' WHEN 1 THEN '2applefalse' ELSE '3true' END) AS h, farm_fingerprint(concat('3', string(o_orderkey = o_orderkey))) AS g,
gcformat(multiclass_label(o_custkey), continuous(o_orderkey), discrete('1footrue'), continuous(o_custkey)) AS a FROM orders""",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN -1541654101129638711 WHEN 1 THEN 2794438866806483259 ELSE -4880158226897771312 END AS h, CAST(-4880158226897771312 AS BIGINT) AS g,
o_custkey || ' | 1:5925585971146611297:' || o_orderkey || ' 2:-1541654101129638711 3:7262150054277104024:' || o_custkey AS a FROM orders""",
)

# ---- retention, buckets, requests

_NOW = 1_360_000_000_000


def _retention(name: str, kind: str, keep: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return retain(_table(spark, sf, "union_t"), ["c1"], "c7", kind, _NOW, 20 * 24 * HOUR, 2, ["id"]).select("id", "c1")

    query(name, f"SELECT id, c1 FROM (SELECT *, coalesce(epoch_ms(c7) >= {_NOW - 20 * 24 * HOUR}, false) AS young, row_number() OVER (PARTITION BY c1 ORDER BY c7 DESC NULLS LAST, id DESC) AS k FROM union_t) t WHERE {keep}")(run)


_retention("retention_absolute", "absolute", "young")
_retention("retention_latest", "latest", "k <= 2")
_retention("retention_either", "absorlat", "young AND k <= 2")
_retention("retention_both", "absandlat", "young OR k <= 2")


@query(
    "long_window_buckets",
    f"""SELECT r.event_id, count(x.value) AS count, round(sum(x.value), 4) AS sum, min(x.value) AS min, max(x.value) AS max FROM events r LEFT JOIN events x ON x.user_id = r.user_id AND epoch_ms(x.ts) BETWEEN epoch_ms(r.ts) - {240 * HOUR} AND epoch_ms(r.ts) GROUP BY r.event_id""",
)
def _long_window(spark: SparkSession, sf: str) -> DataFrame:
    events = _table(spark, sf, "events")
    kinds = [build_buckets(events.filter(c), ["user_id"], "ts", F.col("value"), 24 * HOUR) for c in ("event_id % 2 = 0", "event_id % 2 <> 0")]
    out = long_window(events, events, merge_buckets(*kinds), ["user_id"], "ts", F.col("value"), 240 * HOUR, 24 * HOUR)
    return out.select("event_id", "count", F.round("sum", 4).alias("sum"), "min", "max")


def _asked(features: str, hours: int) -> str:
    return f"""WITH q AS (SELECT row_number() OVER () AS r, id, c1, c3, c7 FROM union_t WHERE epoch_ms(c7) >= 0)
SELECT q.id, {features} FROM q LEFT JOIN udaf_t x ON x.c1 IS NOT DISTINCT FROM q.c1 AND epoch_ms(x.c7) BETWEEN epoch_ms(q.c7) - {hours * HOUR} AND epoch_ms(q.c7) GROUP BY q.r, q.id, q.c3"""


_COUNT_ASKED = "count(x.c3) + CASE WHEN q.c3 IS NULL THEN 0 ELSE 1 END AS n"


@query("request_window", _asked(f"{_COUNT_ASKED}, greatest(max(x.c3), q.c3) AS m", 48))
def _request(spark: SparkSession, sf: str) -> DataFrame:
    requests, history = (_table(spark, sf, t).select("id", "c1", "c3", "c7") for t in ("union_t", "udaf_t"))
    return request_features(requests, history, [(BASE.rows_range("2d"), [Feature("count", "c3", alias="n"), Feature("max", "c3", alias="m")])], ["id"])


@query("deployed_query", _asked(_COUNT_ASKED, 24))
def _deployed(spark: SparkSession, sf: str) -> DataFrame:
    """A deployed query answers each row of union_t, repeated ones and those with a NULL key included, from the history in udaf_t."""
    s = Session(spark)
    columns = ["id", "c1", "c3", "c4", "c5", "c6", "c7", "c8"]
    s.register("history", _table(spark, sf, "udaf_t").select(*columns))
    s.sql("DEPLOY recent SELECT id, count(c3) OVER w AS n FROM history WINDOW w AS (PARTITION BY c1 ORDER BY c7 ROWS_RANGE BETWEEN 1d PRECEDING AND CURRENT ROW)")
    return s.request("recent", _table(spark, sf, "union_t").select(*columns))


dialect(
    "dialect_windows",
    """SELECT id, sum(c3) OVER w1 AS a, count_where(c3, c10) OVER w1 AS b, max(c3) OVER w2 AS c, lag(c3, 1) OVER w1 AS d FROM udaf_t
WINDOW w1 AS (PARTITION BY c1 ORDER BY c7 ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY c1 ORDER BY c7 ROWS_RANGE BETWEEN 2d PRECEDING AND CURRENT ROW MAXSIZE 5)""",
    _RANKED
    + f""", p AS (SELECT c.rid AS of, x.c3, row_number() OVER (PARTITION BY c.rid ORDER BY x.rn DESC) AS k FROM r c JOIN r x ON x.c1 IS NOT DISTINCT FROM c.c1 AND x.rn <= c.rn AND x.ms >= c.ms - {48 * HOUR}), m AS (SELECT of, max(c3) AS c FROM p WHERE k <= 5 GROUP BY of)
SELECT id, CAST(sum(c3) OVER f AS INTEGER) AS a, count(CASE WHEN c10 THEN c3 END) OVER f AS b, m.c, lag(c3, 1) OVER (PARTITION BY c1 ORDER BY rn) AS d FROM r LEFT JOIN m ON m.of = r.rid WINDOW f AS (PARTITION BY c1 ORDER BY rn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
)
