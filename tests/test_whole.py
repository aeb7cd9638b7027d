"""Queries over whole seed sets, against brute force on the collected graph."""

import math
from collections import defaultdict

import pytest

from meshweave.operators import layers
from meshweave.plans import query_graph, query_samples
from meshweave.sources import market

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lists(spark):
    """In-neighbours by node, and the training nodes."""
    g, near = market.market(spark, SF), defaultdict(list)
    for r in g.edges.collect():
        near[r["dst"]].append(r["src"])
    return near, {r["node_id"] for r in market.train_set(g).collect()}, g.num_nodes


def test_degree_hop_ranks_two_hops_of_the_whole_training_set(spark, lists):
    near, train, n = lists
    touched = set(train)
    for _ in range(2):
        touched |= {s for d in touched for s in near[d]}
    sub, out = defaultdict(int), defaultdict(int)
    for d, ss in near.items():
        for s in ss:
            out[s] += 1
            sub[s] += d in touched
    order = sorted(range(n), key=lambda v: (v in touched, sub[v] if v in touched else out[v], v), reverse=True)
    got = sorted(query_samples.f3_rank_degree_hop(spark, SF).collect(), key=lambda r: r["rank"])
    assert [(r["node_id"], r["touched"], r["rank"]) for r in got] == [(v, v in touched, k) for k, v in enumerate(order)]


def test_expected_visits_of_the_whole_training_set(spark, lists):
    near, train, _ = lists
    want = defaultdict(float)
    for seed in train:
        miss = defaultdict(lambda: 1.0)
        for a in near[seed]:
            p = min(1.0, 10 / len(near[seed]))
            miss[a] *= 1 - p
            for b in near[a]:
                miss[b] *= 1 - p * min(1.0, 25 / len(near[a]))
        miss[seed] = 0.0
        for v, m in miss.items():
            want[v] += 1 - m
    got = {r["node_id"]: r["visits"] for r in query_samples.f6_expected_visits(spark, SF).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[v], want[v], abs_tol=1e-4) for v in want)


def test_reach_goes_from_the_training_set_to_the_fixpoint(spark, lists):
    near, train, n = lists
    known, want, new = set(train), [(0, len(train), round(len(train) * 100.0 / n, 6))], set(train)
    while new := {s for d in new for s in near[d]} - known:
        known |= new
        want.append((len(want), len(known), round(len(known) * 100.0 / n, 6)))
    assert sorted(map(tuple, query_graph.g6_reach(spark, SF).collect())) == want


def test_layers_keep_batches_apart(spark):
    """Each batch's rows are those of that batch alone, though nodes and edges recur in others."""
    feats = spark.createDataFrame([(0, [3.0, 4.0]), (1, [1.0, 0.0]), (2, [3.0, 2.0])], "node_id long, feat array<float>")
    edges = spark.createDataFrame([(5, 1, 0, 1), (5, 2, 0, 3), (6, 1, 0, 2), (6, 1, 2, 1), (6, 0, 2, 1)], "batch_key long, src long, dst long, w long")
    scores = spark.createDataFrame([(0, 0.5, 1.0), (1, -3.0, 0.5), (2, 2.0, -1.0)], "node_id long, left double, right double")
    for f, more in ((layers.gcn, ()), (layers.sage_mean, ()), (layers.pin_sage, ()), (layers.attention, (scores,))):
        got = sorted(tuple(r) for r in f(edges, feats, *more, by=["batch_key"]).collect())
        alone = [(b, *r) for b in (5, 6) for r in f(edges.where(f"batch_key = {b}"), feats, *more).collect()]
        assert got == sorted(alone), f.__name__


def test_layers_run_over_every_batch_of_the_epoch(spark, tmp_path):
    """A part table of several batches, the others of sf0.001."""
    import os

    for t in ("supplier", "customer", "orders", "lineitem", "embeddings"):
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.range(1, 2001).selectExpr("id p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    g, f = query_samples.frontier(spark, str(tmp_path))
    batches = {r[0] for r in f.join(g.edges, g.edges["dst"] == f["node_id"]).select("batch_key").distinct().collect()}
    got = {r[0] for r in query_samples.l3_sage_mean(spark, str(tmp_path)).select("batch_key").distinct().collect()}
    assert len(batches) > 1 and got == batches
