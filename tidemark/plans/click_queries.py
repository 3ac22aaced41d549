"""Queries over the click table: features per entity, skewed groups, rolling totals, sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.clicks import clicks, known
from tidemark.operators.feature_table import MEASURES, event_counts, feature_table, since_seconds, type_list
from tidemark.operators.rolling import daily_totals, rolling_totals, with_silent_days
from tidemark.operators.sessions import sessions
from tidemark.operators.skew import skewed_groups
from tidemark.timeutil import day_number, floor_div

GAP_US = 30 * 60 * 1_000_000


def deliveries(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/train_schema.parquet")


def latest_time(raw: DataFrame) -> int:
    """The greatest known click time of all stored rows, in microseconds; 0 if there is none."""
    return raw.select(F.max(known(raw, "click_time"))).first()[0] or 0


def _counts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, int]:
    raw = deliveries(spark, sf)
    as_of = latest_time(raw)
    return raw, event_counts(clicks(raw, "ip", "app", "channel", "click_time"), "ip", ["app", "channel"], "time_us", as_of), as_of


def p1_features(spark: SparkSession, sf: str, apps: Sequence[int] | None = None) -> DataFrame:
    """One row per ip; see ``feature_table``. The recency is measured from the latest click of the table.

    ``apps`` is the explicit list that becomes columns, so that results over different data have the same ones; without it, the apps of the table.
    """
    raw, counts, as_of = _counts(spark, sf)
    return feature_table(counts, "ip", "app", "channel", type_list(raw, "app") if apps is None else apps, as_of)


def p1_unpivoted(spark: SparkSession, sf: str) -> DataFrame:
    """The wide table as rows again, one per ip and app (channel NULL) and per ip, app and channel, and one per ip (app NULL as well)."""
    wide = p1_features(spark, sf)
    own = lambda c: [F.col(c)[m].alias(m) for m in MEASURES]
    apps = [c for c in wide.columns if c.startswith("app_") and c != "app_channel"]
    each = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c.removeprefix("app_")).alias("app"), F.lit(None).cast("string").alias("channel"), *own(c))) for c in apps]))
    parts = lambda e: F.split(e["key"], ":")
    pairs = F.transform(F.map_entries("app_channel"), lambda e: F.struct(parts(e)[0].alias("app"), parts(e)[1].alias("channel"), *[e["value"][m].alias(m) for m in MEASURES]))
    total = F.array(F.struct(F.lit(None).cast("string").alias("app"), F.lit(None).cast("string").alias("channel"), *MEASURES))
    found = wide.select("ip", F.explode(F.concat(total, each, pairs) if apps else F.concat(total, pairs)).alias("e"))
    return found.select("ip", *[F.col("e")[c].cast("int").alias(c) for c in ("app", "channel")], F.col("e.clicks").alias("clicks"), F.round("e.since_last_s", 3).alias("since_last_s"), "e.clicks_7d", "e.clicks_30d")


def p1_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The compact long table behind ``p1_features``: a row per ip, app and channel."""
    _, counts, as_of = _counts(spark, sf)
    return counts.select("ip", "app", "channel", "clicks", F.round(since_seconds(as_of, F.col("last_us")), 3).alias("since_last_s"), "clicks_7d", "clicks_30d")


def _per_key(raw: DataFrame, keys: list[str], share: float) -> DataFrame:
    time = known(raw, "click_time")
    return skewed_groups(raw, keys, "click_id", {"attributed": ("sum", F.coalesce(F.col("is_attributed"), F.lit(0))), "first_us": ("min", time), "last_us": ("max", time)}, share)


def p2_ip_results(spark: SparkSession, sf: str) -> DataFrame:
    """Per ip over all stored rows: rows, clicks, attributed rows, first and last time."""
    return _per_key(deliveries(spark, sf), ["ip"], 0.005).withColumnRenamed("distinct_click_id", "clicks").drop("heavy")


def p2_pair_results(spark: SparkSession, sf: str) -> DataFrame:
    """The same per (ip, app)."""
    return _per_key(deliveries(spark, sf), ["ip", "app"], 0.005).withColumnRenamed("distinct_click_id", "clicks").drop("heavy")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that hold at least a hundredth of the stored rows."""
    raw = deliveries(spark, sf)
    total = raw.count()
    found = _per_key(raw, ["ip", "app"], 0.01).filter(F.col("rows") * 100 >= total)
    return found.filter(F.col("ip").isNotNull() & F.col("app").isNotNull()).select("ip", "app")


def _rolling(spark: SparkSession, sf: str) -> DataFrame:
    events = clicks(deliveries(spark, sf), "ip", "click_time", "is_attributed")
    daily = daily_totals(events, "ip", day_number(F.col("time_us")), {"clicks": F.lit(1).cast("long"), "attributed": F.coalesce(F.col("is_attributed"), F.lit(0)).cast("long")})
    return rolling_totals(with_silent_days(daily, "ip", ["clicks", "attributed"]), "ip", ["clicks", "attributed"])


def _yyyymmdd(day: str):
    return F.date_format(F.date_from_unix_date(day), "yyyyMMdd").cast("int")


def p5_rolling(spark: SparkSession, sf: str) -> DataFrame:
    """Per ip and day: clicks and attributed clicks of the day, totals and averages of the last 7 and 30 days."""
    cols = [f"{m}{k}_{w}d" for w in (7, 30) for m in ("clicks", "attributed") for k in ("", "_avg")]
    return _rolling(spark, sf).select("ip", _yyyymmdd("day").alias("click_day"), "clicks", "attributed", *[F.round(c, 6).alias(c) if "avg" in c else c for c in cols])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Days without a click between two active days at most 30 days apart.

    While an ip is silent its total of the last 30 days falls. The next active day comes within 30 days if and only if the total
    is still above zero on the last silent day before it, so it is the rolling totals that tell.
    """
    run = Window.partitionBy("ip", "prev_day")
    least = F.min(F.when(F.col("clicks") == 0, F.col("clicks_30d"))).over(run)
    return _rolling(spark, sf).withColumn("__least", least).filter((F.col("clicks") == 0) & (F.col("__least") > 0)).select("ip", _yyyymmdd("day").alias("click_day"))


def p6_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each ip and device: start, end, duration and number of clicks."""
    found = sessions(clicks(deliveries(spark, sf), "ip", "device", "click_time"), ["ip", "device"], "time_us", GAP_US)
    return found.select("ip", "device", floor_div(F.col("start_us"), 1000).alias("start_ms"), floor_div(F.col("end_us"), 1000).alias("end_ms"), F.round("duration_s", 3).alias("duration_s"), F.col("events").alias("clicks"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_sessions(spark, sf).select("ip", "device", "start_ms", "end_ms")


_CLICKS = """WITH d AS (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY ingest_time DESC) AS rn FROM train_schema),
c AS (SELECT click_id, ip, app, nullif(device, -1) AS device, os, channel, nullif(click_time, TIMESTAMP '1970-01-01') AS t, is_attributed FROM d WHERE rn = 1),
ref AS (SELECT max(nullif(click_time, TIMESTAMP '1970-01-01')) AS a FROM train_schema)"""

_PER_KEY = """SELECT {keys}, count(*) AS rows, count(DISTINCT click_id) AS clicks, CAST(sum(coalesce(is_attributed, 0)) AS BIGINT) AS attributed,
epoch_us(min(nullif(click_time, TIMESTAMP '1970-01-01'))) AS first_us, epoch_us(max(nullif(click_time, TIMESTAMP '1970-01-01'))) AS last_us
FROM train_schema GROUP BY {keys}"""

_DAYS = _CLICKS + """, a AS (SELECT ip, CAST(t AS DATE) AS d, count(*) AS clicks, CAST(sum(coalesce(is_attributed, 0)) AS BIGINT) AS attributed FROM c WHERE ip IS NOT NULL AND t IS NOT NULL GROUP BY 1, 2)"""

_SESSIONS = _CLICKS + """, k AS (SELECT ip, device, t, CASE WHEN t - lag(t) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM c WHERE ip IS NOT NULL AND device IS NOT NULL AND t IS NOT NULL WINDOW w AS (PARTITION BY ip, device ORDER BY t)),
s AS (SELECT ip, device, t, sum(f) OVER (PARTITION BY ip, device ORDER BY t) AS s FROM k)"""

_UNPIVOTED = """SELECT ip, CAST({app} AS INTEGER) AS app, CAST({channel} AS INTEGER) AS channel, count(*) AS clicks, round(epoch_us(a) / 1e6 - epoch_us(max(t)) / 1e6, 3) AS since_last_s,
CAST(count(*) FILTER (WHERE t > a - INTERVAL 7 DAY) AS BIGINT) AS clicks_7d, CAST(count(*) FILTER (WHERE t > a - INTERVAL 30 DAY) AS BIGINT) AS clicks_30d FROM k WHERE {where} GROUP BY ip, a{by}"""

QUERIES = {f.__name__: f for f in (p1_features, p1_event_counts, p1_unpivoted, p2_found, p2_ip_results, p2_pair_results, p5_found, p5_rolling, p6_found, p6_sessions)}

SQL = {
    "p1_event_counts": _CLICKS
    + """ SELECT ip, app, channel, count(*) AS clicks, round(epoch_us(a) / 1e6 - epoch_us(max(t)) / 1e6, 3) AS since_last_s,
CAST(count(*) FILTER (WHERE t > a - INTERVAL 7 DAY) AS BIGINT) AS clicks_7d, CAST(count(*) FILTER (WHERE t > a - INTERVAL 30 DAY) AS BIGINT) AS clicks_30d
FROM c, ref WHERE ip IS NOT NULL GROUP BY ip, app, channel, a""",
    "p1_unpivoted": _CLICKS
    + ", k AS (SELECT ip, app, channel, t, a FROM c, ref WHERE ip IS NOT NULL) "
    + " UNION ALL ".join(_UNPIVOTED.format(app=app, channel=channel, where=where, by=by) for app, channel, where, by in (("NULL", "NULL", "true", ""), ("app", "NULL", "app IS NOT NULL", ", app"), ("app", "channel", "app IS NOT NULL AND channel IS NOT NULL", ", app, channel"))),
    "p2_found": "SELECT ip, app FROM train_schema WHERE ip IS NOT NULL AND app IS NOT NULL GROUP BY ip, app HAVING count(*) * 100 >= (SELECT count(*) FROM train_schema)",
    "p2_ip_results": _PER_KEY.format(keys="ip"),
    "p2_pair_results": _PER_KEY.format(keys="ip, app"),
    "p5_found": _DAYS
    + """, n AS (SELECT ip, d, lead(d) OVER (PARTITION BY ip ORDER BY d) AS e FROM a)
SELECT ip, CAST(strftime(g, '%Y%m%d') AS INTEGER) AS click_day FROM (SELECT ip, unnest(generate_series(d + INTERVAL 1 DAY, e - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS g FROM n WHERE e - d <= 30) x""",
    "p5_rolling": _DAYS
    + """, b AS (SELECT ip, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS d FROM a GROUP BY ip),
f AS (SELECT b.ip, CAST(b.d AS DATE) AS d, coalesce(a.clicks, 0) AS clicks, coalesce(a.attributed, 0) AS attributed FROM b LEFT JOIN a ON a.ip = b.ip AND a.d = CAST(b.d AS DATE))
SELECT ip, CAST(strftime(d, '%Y%m%d') AS INTEGER) AS click_day, clicks, attributed,
CAST(sum(clicks) OVER w7 AS BIGINT) AS clicks_7d, round(sum(clicks) OVER w7 / 7.0, 6) AS clicks_avg_7d, CAST(sum(attributed) OVER w7 AS BIGINT) AS attributed_7d, round(sum(attributed) OVER w7 / 7.0, 6) AS attributed_avg_7d,
CAST(sum(clicks) OVER w30 AS BIGINT) AS clicks_30d, round(sum(clicks) OVER w30 / 30.0, 6) AS clicks_avg_30d, CAST(sum(attributed) OVER w30 AS BIGINT) AS attributed_30d, round(sum(attributed) OVER w30 / 30.0, 6) AS attributed_avg_30d
FROM f WINDOW w7 AS (PARTITION BY ip ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY ip ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    "p6_found": _SESSIONS + " SELECT ip, device, epoch_ms(min(t)) AS start_ms, epoch_ms(max(t)) AS end_ms FROM s GROUP BY ip, device, s",
    "p6_sessions": _SESSIONS + " SELECT ip, device, epoch_ms(min(t)) AS start_ms, epoch_ms(max(t)) AS end_ms, round((epoch_us(max(t)) - epoch_us(min(t))) / 1e6, 3) AS duration_s, count(*) AS clicks FROM s GROUP BY ip, device, s",
}
