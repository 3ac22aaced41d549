"""Aggregates by category over short and long frames, which are computed in different ways, against plain Python."""

import random

import pytest

from tidemark.operators.features import Feature, window_features
from tidemark.operators.frames import Frame


@pytest.mark.parametrize("start", [4, 40, None])
def test_short_and_long_frames(spark, start):
    rnd = random.Random(2)
    rows = [(i, i % 2, rnd.choice(["a", "b", "c", None]), rnd.choice([None, *range(-5, 9)]), rnd.random() < 0.5) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, k int, c string, v int, w boolean")
    names = ("count_cate", "sum_cate", "avg_cate", "min_cate", "max_cate")
    feats = [Feature(n, "v", "c", alias=n) for n in names] + [Feature("top_n_value_sum_cate_where", "v", "w", "c", 2, alias="top"), Feature("topn_frequency", "c", 2, alias="most"), Feature("top1_ratio", "c", alias="share")]
    got = {r.id: r for r in window_features(df, [(Frame(["k"], "id", tie=["v"]).rows(start), feats)], ["id"]).collect()}
    for i, k, *_ in rows:
        mine = [r for r in rows if r[1] == k and r[0] <= i]
        mine = mine if start is None else mine[-start - 1 :]
        per, top = {}, {}
        for _, _, c, v, w in mine:
            if c is not None and v is not None:
                per.setdefault(c, []).append(v)
                if w:
                    top.setdefault(c, []).append(v)
        text = lambda f: ",".join(f"{c}:{f(vs)}" for c, vs in sorted(per.items()))
        assert [got[i][n] for n in names] == [text(len), text(sum), text(lambda x: f"{sum(x) / len(x):.6f}"), text(min), text(max)]
        best = sorted(((sum(vs), c) for c, vs in top.items()), reverse=True)[:2]
        assert got[i].top == ",".join(f"{c}:{v}" for v, c in best)
        known = [r[2] for r in mine if r[2] is not None]
        often = sorted(set(known), key=lambda c: (-known.count(c), c))[:2]
        assert got[i].most == ",".join(often + ["NULL"] * (2 - len(often)))
        assert got[i].share == pytest.approx(max(map(known.count, known)) / len(known) if known else 0.0)
