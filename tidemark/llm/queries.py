"""Queries of the operators for training data."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.distinct import bitmap_bits, bitmaps, distinct_counts, estimates, merge_partials, roll_up
from tidemark.llm.frequent import frequent_items
from tidemark.llm.leakage import leaks
from tidemark.llm.packing import TOKEN, fill_containers, token_count
from tidemark.llm.residue import scan_residue
from tidemark.operators.clicks import clicks
from tidemark.storage import stored
from tidemark.timeutil import day_number

CAPACITY = 2048
SHARE = 1 / 200
#: Groups of problem 3, and the number of ips up to which its figures keep their error.
GROUPS, MOST_IPS = ["day", "app", "channel"], 1 << 24


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _ip_clicks(spark: SparkSession, sf: str) -> DataFrame:
    return clicks(_table(spark, sf, "train_schema"), "ip", "app", "channel", "click_time").select("click_id", "ip", "app", "channel", day_number(F.col("time_us")).alias("day"))


def _yyyymmdd() -> Column:
    return F.date_format(F.date_from_unix_date("day"), "yyyyMMdd").cast("int").alias("click_day")


def p3_distinct_ips(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct ips of the clicks per day, app, channel and each combination, with the standard error.

    The bitmaps have a fixed size: that which estimates up to ``MOST_IPS`` ips to within one in a hundred.
    """
    found = distinct_counts(_ip_clicks(spark, sf), GROUPS, "ip", MOST_IPS, 0.01)
    return found.select("level", _yyyymmdd(), "app", "channel", "estimate", "std_error", "saturated", "bits")


def p3_partials(spark: SparkSession, sf: str) -> DataFrame:
    """The mergeable partial results: words of the bitmap of each day, app and channel, with its size."""
    found = bitmaps(_ip_clicks(spark, sf), GROUPS, "ip", MOST_IPS, 0.01)
    return found.select(_yyyymmdd(), "app", "channel", "word", "bits", "size")


def p3_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Per level the number of groups, and whether all estimates from the merged partials of two halves of the clicks are those of the whole."""
    events = _ip_clicks(spark, sf)
    halves = [bitmaps(events.filter(F.pmod("click_id", F.lit(2)) == i), GROUPS, "ip", MOST_IPS, 0.01) for i in (0, 1)]
    bits, by = bitmap_bits(MOST_IPS, 0.01), ["level", *GROUPS]
    merged = estimates(roll_up(merge_partials(*halves), GROUPS), by, bits).select(*by, F.col("estimate").alias("merged"), F.lit(None).cast("double").alias("whole"))
    whole = distinct_counts(events, GROUPS, "ip", MOST_IPS, 0.01).select(*by, F.lit(None).cast("double").alias("merged"), F.col("estimate").alias("whole"))
    per = merged.unionByName(whole).groupBy(*by).agg(F.max("merged").alias("merged"), F.max("whole").alias("whole"))
    return per.groupBy("level").agg(F.count(F.lit(1)).alias("groups"), F.bool_and(F.coalesce(F.col("merged") == F.col("whole"), F.lit(False))).alias("same"))


def p3_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Each group's exact number of ips, and whether the estimate lies within four standard errors of it, or within two ips."""
    events, by = _ip_clicks(spark, sf), ["level", *GROUPS]
    pairs = events.groupBy(*GROUPS, "ip").agg(F.lit(1).alias("one")).select(*GROUPS, "ip")
    exact = None
    for size in range(len(GROUPS), -1, -1):
        for kept in combinations(GROUPS, size):
            part = pairs.groupBy(*kept).agg(F.count_distinct("ip").alias("exact")) if kept else pairs.agg(F.count_distinct("ip").alias("exact")).filter("exact > 0")
            part = part.select(F.lit(",".join(kept)).alias("level"), *[F.col(g) if g in kept else F.lit(None).cast(events.schema[g].dataType).alias(g) for g in GROUPS], "exact", F.lit(None).cast("double").alias("estimate"), F.lit(None).cast("double").alias("std_error"))
            exact = part if exact is None else exact.unionByName(part)
    found = distinct_counts(events, GROUPS, "ip", MOST_IPS, 0.01).select(*by, F.lit(None).cast("bigint").alias("exact"), "estimate", "std_error")
    per = exact.unionByName(found).groupBy(*by).agg(*[F.max(c).alias(c) for c in ("exact", "estimate", "std_error")])
    near = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(4 * F.col("std_error") * F.col("exact"), F.lit(2.0))
    return per.select("level", _yyyymmdd(), "app", "channel", "exact", F.coalesce(near, F.lit(False)).alias("near"))


def p4_frequent(spark: SparkSession, sf: str) -> DataFrame:
    """Known values of ip and device that at least one click in 200 has, with approximate and exact counts.

    The clicks are kept as a table in the shared folder, as they are read twice: for the sketch, and for the second scan.
    """
    kept = stored(clicks(_table(spark, sf, "train_schema"), "ip", "device").select("ip", "device"), "clicks")
    return frequent_items(kept, ["ip", "device"], SHARE)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_frequent(spark, sf).select("field_name", F.col("field_value").cast("int").alias("field_value"))


def p4_checked(spark: SparkSession, sf: str) -> DataFrame:
    """The values with their exact counts, and whether the sketch's count is within a tenth of the share of it."""
    found = p4_frequent(spark, sf)
    return found.select("field_name", F.col("field_value").cast("int").alias("field_value"), F.col("count").alias("clicks"), (F.abs(F.col("approx_count") - F.col("count")) <= F.col("count") / 10).alias("near"))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in containers of 2048 tokens, a row per piece."""
    return fill_containers(_table(spark, sf, "documents"), "doc_id", token_count(F.col("text")), CAPACITY)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose pieces lie in more than one container: those of more than 2048 tokens are split, no others."""
    lies = p7_containers(spark, sf).groupBy("doc_id").agg(F.min("container_id").alias("first"), F.max("container_id").alias("last"))
    return lies.filter("first < last").select("doc_id")


def p7_checked(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the containers: nothing lost, none overfull, pieces in order, nothing split without need, little room unused."""
    pieces = p7_containers(spark, sf)
    held = pieces.groupBy("container_id").agg(F.sum("tokens").alias("n")).agg(F.count(F.lit(1)).alias("containers"), F.max("n").alias("most"), F.sum("n").alias("tokens"))
    per = pieces.groupBy("doc_id").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("k"), F.max("piece").alias("last"), F.bool_and(F.col("first_token") == F.col("piece") * CAPACITY).alias("placed"))
    per = per.agg(F.count(F.lit(1)).alias("documents"), F.sum("k").alias("pieces"), F.bool_and(F.col("placed") & (F.col("last") == F.col("k") - 1)).alias("in_order"), F.bool_and((F.col("n") > CAPACITY) | (F.col("k") == 1)).alias("whole"))
    tight = F.col("containers") <= 1.03 * F.ceil(F.col("tokens") / CAPACITY) + 1
    return per.withColumn("all", F.lit(1)).join(held.withColumn("all", F.lit(1)), "all").filter("documents > 0").select("documents", "pieces", F.col("tokens"), (F.col("most") <= CAPACITY).alias("none_overfull"), "in_order", "whole", tight.alias("tight"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold an item's passage, wholly or partly, and the item."""
    return leaks(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"))


def p8_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Of the pairs found, those whose passage, of 16 words or more, stands in the text word by word; plain words of ASCII letters and digits."""
    texts, items = _table(spark, sf, "documents"), _table(spark, sf, "eval_items")
    words = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))
    pairs = p8_found(spark, sf).distinct().join(items.select("item_id", words(F.col("passage")).alias("passage")), "item_id").join(texts.select("doc_id", words(F.col("text")).alias("text")), "doc_id")
    return pairs.filter(F.contains("text", "passage") & (F.size(F.split(F.trim("passage"), " ")) >= 16)).select("doc_id", "item_id")


def p9_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Each document whose list of cells is known: its number of text cells, and whether the other figures agree with each other."""
    known = _table(spark, sf, "documents").filter("cell_types IS NOT NULL AND cell_starts IS NOT NULL AND text IS NOT NULL AND text <> ''")
    whole = F.when(F.col("kind").isNull(), (F.col("residue_cells") == 0) & (F.col("coverage") == 0)).otherwise((F.col("residue_cells") > 0) & (F.col("coverage") > 0))
    return scan_residue(known).select("doc_id", F.col("cells"), (whole & (F.col("residue_cells") <= F.col("cells")) & (F.col("coverage") <= 1)).alias("agrees"))


def p9_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's number of text cells, of those with residue, and the kind of residue."""
    return scan_residue(_table(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_cells(spark, sf).filter("kind IS NOT NULL").select("doc_id")


_CLICKS = """WITH d AS (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY ingest_time DESC) AS rn FROM train_schema),
c AS (SELECT ip, nullif(device, -1) AS device FROM d WHERE rn = 1), n AS (SELECT count(*) AS n FROM c),
v AS (SELECT 'ip' AS field_name, ip AS field_value, count(*) AS k FROM c WHERE ip IS NOT NULL GROUP BY ip UNION ALL SELECT 'device', device, count(*) FROM c WHERE device IS NOT NULL GROUP BY device)"""

_LEVELS = [kept for size in range(3, -1, -1) for kept in combinations(("click_day", "app", "channel"), size)]


def _levels(select: str) -> str:
    """A select over each combination of day, app and channel, from table ``e`` of clicks."""
    named = lambda k: ",".join("day" if c == "click_day" else c for c in k)
    columns = lambda k: ", ".join(c if c in k else f"CAST(NULL AS INTEGER) AS {c}" for c in ("click_day", "app", "channel"))
    return " UNION ALL ".join(f"SELECT '{named(k)}' AS level, {columns(k)}, {select} FROM e {'GROUP BY ' + ', '.join(k) if k else 'HAVING count(*) > 0'}" for k in _LEVELS)


_DAYS = """WITH d AS (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY ingest_time DESC) AS rn FROM train_schema),
e AS (SELECT ip, app, channel, CAST(strftime(nullif(click_time, TIMESTAMP '1970-01-01'), '%Y%m%d') AS INTEGER) AS click_day FROM d WHERE rn = 1)"""

QUERIES = {f.__name__: f for f in (p3_distinct_ips, p3_partials, p3_merged, p3_checked, p4_found, p4_frequent, p4_checked, p7_found, p7_containers, p7_checked, p8_found, p8_whole, p9_found, p9_cells, p9_checked)}

SQL = {
    "p3_checked": f"{_DAYS} {_levels('count(DISTINCT ip) AS exact, true AS near')}",
    "p3_merged": f"{_DAYS} SELECT level, count(*) AS groups, true AS same FROM ({_levels('1 AS one')}) x GROUP BY level",
    "p4_checked": _CLICKS + " SELECT field_name, field_value, k AS clicks, true AS near FROM v, n WHERE k * 200 >= n",
    "p8_whole": r"""WITH t AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS text FROM documents), p AS (SELECT item_id, ' ' || trim(regexp_replace(lower(passage), '[^a-z0-9]+', ' ', 'g')) || ' ' AS passage FROM eval_items)
SELECT doc_id, item_id FROM t, p WHERE contains(text, passage) AND len(string_split(trim(passage), ' ')) >= 16""",
    "p9_checked": "SELECT doc_id, CAST(len([x for x in cell_types if x = 'text']) AS INTEGER) AS cells, true AS agrees FROM documents WHERE cell_types IS NOT NULL AND cell_starts IS NOT NULL AND text IS NOT NULL AND text <> ''",
    "p4_found": _CLICKS + " SELECT field_name, field_value FROM v, n WHERE k * 200 >= n",
    "p7_checked": f"""WITH t AS (SELECT coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0) AS n FROM documents)
SELECT count(*) AS documents, CAST(sum(greatest(1, (n + {CAPACITY - 1}) // {CAPACITY})) AS BIGINT) AS pieces, CAST(sum(n) AS BIGINT) AS tokens, true AS none_overfull, true AS in_order, true AS whole, true AS tight FROM t""",
    "p7_found": r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[A-Za-z0-9_]{1,8}|[^A-Za-z0-9_ \t\r\n]')) > 2048",
}
