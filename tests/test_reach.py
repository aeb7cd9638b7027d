"""The last hop of all batches at once against sets, in small blocks, groups and pieces, with nodes in many lists."""

import random

import pytest
from pyspark.sql import functions as F

from meshweave.operators import build, cache, reach, sampling
from meshweave.plans.session import prepare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    prepare(spark)
    rng = random.Random(7)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(300)] + [(7, d) for d in range(40)] + [(3, 5)] * 3
    seeds = {(b, rng.randrange(60)) for b in (-4, 0, 1, 2, 900) for _ in range(3)} | {(5, 999)}
    return pairs, sorted(seeds), spark.createDataFrame(pairs, "src long, dst long").cache()


@pytest.mark.parametrize("small", [None, {"BLOCK": 9, "GROUP": 30, "CELLS": 7, "PIECE": 3}])
def test_counts_of_two_hops(spark, graph, monkeypatch, small):
    if small:
        for k, v in small.items():
            monkeypatch.setattr(reach, k, v)
        assert reach._dealt(graph[2].select(F.col("src").alias("v"), F.col("dst").alias("u")))[1].count() > 0  # node 7 is in too many lists
    pairs, seeds, edges = graph
    near = {(b, v) for b, v in seeds} | {(b, s) for b, v in seeds for s, d in pairs if d == v}
    want = near | {(b, s) for b, v in near for s, d in pairs if d == v}
    h1 = sampling.all_neighbour_frontier(edges, spark.createDataFrame(seeds, "batch_key long, node_id long"), 1)
    got = dict(map(tuple, reach.last_hop(edges, h1).select("node_id", "freq").collect()))
    assert got == {v: sum(x == v for _, x in want) for v in {v for _, v in want}}
    per = sorted(map(tuple, reach.last_hop(edges, h1, by_batch=True).select("batch_key", "num_node", "id_sum").collect()))
    assert per == sorted((b, sum(x == b for x, _ in want), sum(v for x, v in want if x == b)) for b in {b for b, _ in want})
    assert reach.last_hop(edges, h1.limit(0)).count() == 0


def test_no_row_for_a_batch_and_a_node(spark):
    """What is shuffled to count a graph's reach is its edges, not each batch's nodes."""
    from meshweave.plans import query_samples

    plan = query_samples.c10_all_neighbour_hops(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan


@pytest.mark.parametrize("small", [{"BLOCK": 20, "GROUP": 12, "PIECE": 5}, {"WIDEST": 2, "PIECE": 1}])
@pytest.mark.parametrize("simple", [True, False])
def test_visits_in_small_pieces(spark, monkeypatch, small, simple):
    """Blocks of a few seeds, groups of a few edges, nodes in too many lists, and nodes with more paths than a piece."""
    for k, v in small.items():
        monkeypatch.setattr(reach, k, v)
    r = random.Random(4)
    pairs = {(r.randrange(10), r.randrange(10)) for _ in range(25)} | {(10 + k, r.randrange(10)) for k in range(5)} | {(r.randrange(10), 15 + k) for k in range(5)} | {(0, d) for d in range(14)} | {(2, 2), (16, 16)}
    pairs = sorted(pairs) if simple else sorted(pairs) + [(0, 1), (0, 1), (4, 15)]
    lists = {d: [s for s, e in pairs if e == d] for d in range(20)}
    train, want = [*range(0, 10, 2), *range(10, 20)], {}
    for s in train:
        miss = {}
        for m in lists[s]:
            p = min(1, 2 / len(lists[s]))
            miss[m] = miss.get(m, 1) * (1 - p)
            for n in lists[m]:
                miss[n] = miss.get(n, 1) * (1 - p * min(1, 3 / len(lists[m])))
        miss[s] = 0
        for n, x in miss.items():
            want[n] = want.get(n, 0) + 1 - x
    edges, nodes = spark.createDataFrame(pairs, "src long, dst long"), spark.range(20).withColumnRenamed("id", "node_id")
    seeds = spark.createDataFrame([(s,) for s in train], "node_id long")
    got = dict(map(tuple, cache.expected_visits(edges, build.degrees(nodes, edges), seeds, (3, 2), simple).collect()))
    assert got == pytest.approx(want, abs=1e-9)
    assert not cache.expected_visits(edges, build.degrees(nodes, edges), seeds.limit(0), (3, 2), simple).count()
