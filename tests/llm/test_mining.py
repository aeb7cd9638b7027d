"""op12: brute force with whole numbers over fixtures with nulls, ties, repeated rows, small blocks, large values and clashing names."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.llm import mining

SHAPE = "vec_id long, embedding array<double>, label int"


def brute(rows, scale=256, anchor=lambda i: i % 50 == 0):
    def fits(v):
        top = max((abs(x) for x in v), default=0) * scale + 1
        return top < 2**32 and len(v) * top**2 < 2**63

    good = [(i, [math.floor(x * scale) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and fits(v)]
    out = []
    for i, v, lab in good:
        if not anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in good if j != i and len(w) == len(v)]
        near = sorted((-s, j) for s, j, m in scored if m == lab)[:5]
        for ps, p in near:
            hard = sorted((-s, j) for s, j, m in scored if m != lab and 50 * -ps <= 100 * s <= 95 * -ps)[:3]
            out += [(i, p, r, n, -ps, -s) for r, (s, n) in enumerate(hard, 1)]
    return sorted(out)


def mined(df, **more):
    found = mining.mine(mining.prepared(df), F.col("vec_id") % 50 == 0, **more)
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def cloud(n, dim, seed=0, step=0.25):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(4, dim))
    v = np.round((base[rng.integers(0, 4, n)] + rng.normal(size=(n, dim))) / step) * step  # coarse, so that scores tie
    return [(i, [float(x) for x in v[i]], int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("more", [{}, {"anchor_rows": 3, "block_rows": 7}, {"anchor_rows": 1, "block_rows": 1000}])
def test_equals_brute_force(spark, more):
    rows = cloud(400, 6)
    got = mined(spark.createDataFrame(rows, SHAPE).repartition(5), **more)
    assert got == brute(rows) and len(got) > 50


def test_more_anchor_blocks_than_are_broadcast_at_once(spark, monkeypatch):
    monkeypatch.setattr(mining, "AT_ONCE", 2)
    rows = cloud(600, 4, 3)
    assert mined(spark.createDataFrame(rows, SHAPE).repartition(3), anchor_rows=2, block_rows=64) == brute(rows)


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = cloud(120, 3, 1) + [
        (None, [1.0, 1.0, 1.0], 1), (200, None, 1), (250, [1.0, None, 1.0], 0), (201, [nan, 1.0, 1.0], 0), (202, [inf, 1.0, 1.0], 1), (203, [1.0, 1.0, 1.0], None),
        (300, [], 0), (301, [], 0), (302, [], 1), (350, [2.0], 1), (351, [3.0], 1), (352, [2.0], 2), (400, [1.0, 2.0, 3.0, 4.0], 5),
        (450, [1e300, 1.0, 1.0], 0), (50, [1.0, 1.0, 1.0], 0), (51, [1.0, 1.0, 1.0], 0), (51, [1.0, 1.0, 1.0], 0), (0, [0.0, 0.0, 0.0], 2),
    ]
    got = mined(spark.createDataFrame(rows, SHAPE))
    assert got == brute(rows) and any(r[0] == 50 for r in got)


def test_a_third_of_all_rows_alike(spark):
    rows = cloud(200, 4, 5) + [(1000 + i, [1.0, 1.0, 0.5, 0.0], i % 2) for i in range(100)]
    assert mined(spark.createDataFrame(rows, SHAPE).repartition(4), block_rows=32) == brute(rows)


def test_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.integers(2**20, 2**21, 2)], int(i % 2)) for i in range(200)]  # scores near 2**59
    assert mined(spark.createDataFrame(rows, SHAPE)) == brute(rows)


def test_window_bounds():
    p = np.array([0, 1, 2, 3, 101, -1, -7, 2**62 + 1])
    low, high = mining.window(p)
    assert low.tolist() == [-(-50 * int(x) // 100) for x in p] and high.tolist() == [95 * int(x) // 100 for x in p]


def test_empty_and_clashing_columns(spark):
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    assert mining.mine(mining.prepared(spark.createDataFrame([], SHAPE)), F.col("vec_id") % 50 == 0).count() == 0
    no_anchor = spark.createDataFrame([(1, [1.0], 0)], SHAPE)
    assert mining.mine(mining.prepared(no_anchor), F.col("vec_id") % 50 == 0).schema == spark.createDataFrame([], names).schema
    rows = cloud(150, 3, 7)
    odd = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 AS block", "2 AS ids", "'x' AS data", "3 AS rank", "4 AS v")
    assert mined(odd) == brute(rows)
    named = spark.createDataFrame(rows, SHAPE).toDF("the.id", "vec", "class")
    found = mining.mine(mining.prepared(named, "the.id", "vec", "class"), F.col("vec_id") % 50 == 0)
    assert found.count() == len(brute(rows))
