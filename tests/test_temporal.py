"""As-of and interval joins against plain loops, with a key that holds a third of the rows; selection against sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.functions import selection
from meshweave.operators import temporal


def as_of(left, right):
    out = []
    for i, k, t in left:
        fit = [(rt, tie, v) for rk, rt, tie, v in right if None not in (k, t, rk, rt) and rk == k and rt <= t]
        out.append((i, k, t, max(fit)[2] if fit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_as_of_equals_a_loop(spark, ranges):
    rng = np.random.default_rng(ranges)
    key = lambda: 0 if rng.random() < 0.34 else int(rng.integers(1, 9))
    left = [(i, key(), int(rng.integers(0, 200))) for i in range(300)] + [(900, None, 5), (901, 3, None), (902, 77, 5)]
    right = [(key(), int(rng.integers(0, 200)), j, f"v{j}") for j in range(120)] + [(None, 1, 500, "n"), (0, None, 501, "t")]
    a = spark.createDataFrame(left, "id long, k long, t long").repartition(4)
    b = spark.createDataFrame(right, "k long, t long, tie long, v string").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = temporal.as_of_join(a, b, "k", "t", "v", tie=F.col("tie"))
        assert sorted(map(tuple, joined.collect()), key=repr) == as_of(left, right)
        assert "NestedLoop" not in joined._jdf.queryExecution().toString() and "Cartesian" not in joined._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_as_of_without_rows(spark):
    a, b = spark.createDataFrame([(1, 2)], "k long, t long"), spark.createDataFrame([], "k long, t long, v string")
    assert [tuple(r) for r in temporal.as_of_join(a, b, "k", "t", "v").collect()] == [(1, 2, None)]
    assert temporal.as_of_join(a.limit(0), b, "k", "t", "v").count() == 0


def test_intervals_equal_a_loop(spark):
    rng = np.random.default_rng(4)
    key = lambda: 0 if rng.random() < 0.34 else int(rng.integers(1, 9))
    points = [(i, key(), int(rng.integers(-500, 500))) for i in range(300)] + [(900, None, 5), (901, 3, None)]
    spans = [(j, key(), s, s + int(n)) for j, (s, n) in enumerate(zip(rng.integers(-500, 500, 150).tolist(), rng.geometric(0.05, 150)))]
    spans += [(500, 0, -10_000, 10_000), (501, 1, 5, 5), (502, 1, 9, 3), (503, None, 0, 9), (504, 2, None, 9)]
    a, b = spark.createDataFrame(points, "i long, k long, t long"), spark.createDataFrame(spans, "j long, k long, s long, e long")
    got = temporal.interval_join(a, b, "k", "t", "s", "e")
    want = sorted((i, j) for i, k, t in points for j, k2, s, e in spans if None not in (k, t, k2, s, e) and k == k2 and s <= t < e)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want and len(want) > 100
    assert temporal.interval_join(a, b.limit(0), "k", "t", "s", "e").count() == 0


def test_intervals_of_timestamps(spark):
    a = spark.sql("SELECT 1 AS k, timestamp'2024-01-01 10:00:00' AS t UNION ALL SELECT 1, timestamp'2024-01-01 12:00:00'")
    b = spark.sql("SELECT 1 AS k, timestamp'2024-01-01 09:00:00' AS s, timestamp'2024-01-01 12:00:00' AS e, 'x' AS name")
    assert [str(r["t"]) for r in temporal.interval_join(a, b, "k", "t", "s", "e").collect()] == ["2024-01-01 10:00:00"]


@pytest.mark.parametrize("few", [1, 7, 100_000])
@pytest.mark.parametrize("descending", [False, True])
def test_selection_equals_sorting(spark, monkeypatch, few, descending):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "PIVOTS", 5)
    rng = np.random.default_rng(few)
    rows = [(int(v), i) for i, v in enumerate(np.concatenate([rng.integers(-50, 50, 150), np.full(120, 7), rng.integers(-(2**40), 2**40, 30)]))]
    df = spark.createDataFrame(rows, "v long, id long").repartition(3)
    order = sorted(rows, reverse=descending)
    for k in (0, 1, 2, 149, 200, 299, 300, 1000):
        assert sorted(map(tuple, selection.first_k(df, k, "v", "id", descending).collect())) == sorted(order[:k]), k


def test_selection_moves_no_rows(spark):
    got = selection.first_k(spark.range(1000).select((F.col("id") % 10).alias("v"), "id"), 250, "v", "id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 250 and "Exchange" not in plan and "Sort" not in plan
