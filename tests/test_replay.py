"""Tables replayed through streaming operators with timers."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.sessions import fragments, session_timers, sessions
from tidemark.storage import shared_folder
from tidemark.streaming.replay import replay


def test_sessions_across_slices(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), None if rnd.random() < 0.02 else rnd.randint(-500, 3000)) for _ in range(600)]
    rows += [(9, t) for t in range(0, 3000, 7)]  # one session through all slices
    got = sessions(spark.createDataFrame(rows, "k int, t bigint"), ["k"], "t", 10, slice_us=400)
    want = []
    for k in (1, 2, 3, 9):
        run = []
        for t in sorted(t for x, t in rows if x == k and t is not None):
            if run and t - run[-1] > 10:
                want.append((k, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        want.append((k, run[0], run[-1], len(run)))
    assert sorted(map(tuple, got.select("k", "start_us", "end_us", "events").collect())) == sorted(want)
    assert (9, 0, 2996, 429) in want


def test_timers_that_have_not_run_out_are_an_error(spark):
    part = fragments(spark.createDataFrame([(1, 5), (2, 900)], "k int, t bigint"), ["k"], "t", 10)

    def too_early(number):
        return spark.range(1).select(F.lit(None).cast("int").alias("k"), F.lit(901).alias("first_us"), F.lit(901).alias("last_us"), F.lit(0).alias("events"))

    with pytest.raises(RuntimeError):
        replay(part, F.lit(0).cast("bigint"), lambda s: session_timers(s, ["k"], 10), too_early)


def test_shared_folder(spark):
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda name, default=None: default)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared_folder(Cluster, "x")
