"""The buckets of growing length that cover a span of buckets."""

import random

from pyspark.sql import functions as F

from tidemark.operators.preagg import _cover


def test_cover_is_exact_and_small(spark):
    rnd = random.Random(3)
    spans = [(a, a + rnd.randint(-2, 60)) for a in (rnd.randint(-70, 70) for _ in range(300))]
    df = spark.createDataFrame(spans, "a long, b long")
    for most in (0, 1, 3, 5):
        for r in df.select("a", "b", _cover(F.col("a"), F.col("b"), most).alias("c")).collect():
            covered = [x for p in r.c for x in range(p.bucket << p.level, (p.bucket + 1) << p.level)]
            assert sorted(covered) == list(range(r.a, r.b + 1)), (r, most)
            assert len(r.c) <= 2 * most + max(0, r.b - r.a + 1 >> most)
