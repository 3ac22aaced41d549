import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.fingerprint import fingerprint, hash64, signed
from tidemark.operators.features import Feature
from tidemark.operators.frames import Frame
from tidemark.operators.preagg import merge_buckets
from tidemark.sources.files import Options, read, write
from tidemark.sources.streams import append_to, file_rows
from tidemark.streaming.live import first_deliveries, live_buckets, live_sessions, serve_requests


def test_csv_times_and_bad_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,ts,ok,v\n1,1590738990000,yes,2.5\n2,2020-05-29 07:56:30,no,x\nnull,null,maybe,null\n")
    schema = T._parse_datatype_string("id int, ts timestamp, ok boolean, v double")
    got = [tuple(r) for r in read(spark, str(tmp_path / "a.csv"), Options(), schema).collect()]
    assert [r[0] for r in got] == [1, 2, None] and got[0][1] == got[1][1] is not None and [r[2] for r in got] == [True, False, None] and [r[3] for r in got] == [2.5, None, None]


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_write_and_read(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    options = Options(format=kind, coalesce=1)
    write(df, str(tmp_path / "o"), options)
    with pytest.raises(Exception):
        write(df, str(tmp_path / "o"), options)
    write(df, str(tmp_path / "o"), Options(format=kind, mode="append"))
    assert sorted((r.id, r.s) for r in read(spark, str(tmp_path / "o"), options, df.schema).collect() if r.s) == [(1, "a"), (1, "a")]
    with pytest.raises(ValueError):
        Options.of({"mode": "sometimes"})


def stream_of(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return file_rows(spark, str(tmp_path / "in"), T._parse_datatype_string(schema), files_per_batch=1)


def run(writer, tmp_path):
    q = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_live_sessions(spark, tmp_path):
    at = lambda m: dt.datetime(2020, 1, 1) + dt.timedelta(minutes=m)
    s = stream_of(spark, tmp_path, [[(1, at(0)), (1, at(20)), (2, at(5)), (None, at(1))], [(1, at(45)), (1, at(100)), (2, None)], [(3, at(1000))]], "k int, t timestamp")
    run(live_sessions(s, ["k"], "t", "30 minutes", "60 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")), tmp_path)
    got = sorted((r.k, r.start, r.end, r.events) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, at(0), at(45), 3), (1, at(100), at(100), 1), (2, at(5), at(5), 1)]


def test_live_buckets_requests_and_deliveries(spark, tmp_path):
    s = stream_of(spark, tmp_path, [[(1, 5, 2), (1, 15, 3)], [(1, 6, 10)]], "k int, t bigint, v int")
    run(live_buckets(s, ["k"], "t", "v", 10, str(tmp_path / "b")), tmp_path)
    got = merge_buckets(spark.read.parquet(str(tmp_path / "b")).drop("batch"))
    assert sorted((r.bucket, r["count"], r["sum"]) for r in got.collect()) == [(0, 2, 12), (1, 1, 3)]

    history = spark.createDataFrame([(1, 1, 7), (1, 90, 5)], "k int, t bigint, v int")
    out = []
    frames = [(Frame(["k"], "t").rows_range(10), [Feature("sum", "v", alias="s")])]
    (tmp_path / "r").mkdir()
    run(serve_requests(s, lambda: history, frames, lambda df, n: out.extend((r.t, r.s) for r in df.collect())), tmp_path / "r")
    assert sorted(out) == [(5, 9), (6, 17), (15, 3)]


def test_first_deliveries_and_copies(spark, tmp_path):
    t = dt.datetime(2020, 1, 1)
    s = stream_of(spark, tmp_path, [[("a", t), ("a", t), ("b", t)], [("a", t)]], "k string, t timestamp")
    q = append_to(first_deliveries(s, "k", "t", "1 hour"), str(tmp_path / "o"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["a", "b"]


def test_fingerprint(spark):
    df = spark.createDataFrame([(3, "x"), (None, None), (-1, "a" * 100)], "n int, s string")
    assert [r[0] for r in df.select(hash64(F.col("n"), "int")).collect()][:2] == [2681491882390849628, None]
    assert [r[0] for r in df.select(hash64(F.col("s"), "string")).collect()] == [signed(fingerprint(b"x")), None, signed(fingerprint(b"a" * 100))]
    assert df.select(hash64(F.lit(2).cast("bigint"), "bigint")).first()[0] == 3353244675891348105
