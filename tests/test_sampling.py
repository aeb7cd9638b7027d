"""Samplers over graphs with copies of edges, hubs and ties; tables and ranks against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.functions import ranks
from meshweave.operators import build, layers, sampling, weights


def chi_square(counts, shares, n):
    return sum((counts.get(k, 0) - p * n) ** 2 / (p * n) for k, p in shares.items())


@pytest.mark.parametrize("draw", ["digest", "places", "weighted"])
def test_copies_of_an_edge_are_drawn_each_by_itself(spark, draw):
    """Two of the list 1, 1, 1, 2, 2, 2: a fifth of the samples are 1 1, a fifth 2 2, the rest both."""
    edges = spark.createDataFrame([(s, 0) for s in (1, 1, 1, 2, 2, 2)], "src long, dst long")
    n = 3000
    many = spark.createDataFrame([(b, 0) for b in range(n)], "batch_key long, node_id long")
    if draw == "digest":
        got = sampling.khop(edges, many, 2, 5)
    elif draw == "places":
        got = sampling.khop_places(build.with_positions(edges), many, 2, 5)
    else:
        got = sampling.khop_weighted(edges.withColumn("w", F.lit(1.0)), many, 2, 5)
    per = got.groupBy("batch_key").agg(F.array_join(F.array_sort(F.collect_list("src")), " ").alias("s")).groupBy("s").count()
    counts = {r["s"]: r["count"] for r in per.collect()}
    assert sum(counts.values()) == n and chi_square(counts, {"1 1": 0.2, "2 2": 0.2, "1 2": 0.6}, n) < 13.8  # two degrees, p = 0.001


@pytest.mark.parametrize("degree", [1, 4, 5, 6, 50])
def test_places_are_a_uniform_subset(spark, degree):
    edges = spark.createDataFrame([(s, 0) for s in range(degree)], "src long, dst long")
    many = spark.createDataFrame([(b, 0) for b in range(1500)] + [(0, 99)], "batch_key long, node_id long")
    rows = sampling.khop_places(build.with_positions(edges), many, 5, 2).collect()
    per = {}
    for r in rows:
        per.setdefault(r["batch_key"], []).append(r["src"])
    size = min(5, degree)
    assert len(per) == 1500 and all(len(v) == len(set(v)) == size for v in per.values())
    counts = {s: sum(s in v for v in per.values()) for s in range(degree)}
    if degree > 5:
        assert chi_square(counts, {s: size / degree for s in range(degree)}, 1500) < 1.8 * degree + 20


def test_a_simple_graph_draws_the_same_whether_known_or_not(spark):
    edges = spark.createDataFrame([(s, d) for d in range(3) for s in range(10)], "src long, dst long")
    f = spark.createDataFrame([(b, d) for b in range(5) for d in range(3)], "batch_key long, node_id long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(sampling.khop(edges, f, 4, 1)) == rows(sampling.khop(edges, f, 4, 1, simple=True))
    w = edges.withColumn("w", F.col("src") + 1.0)
    assert rows(sampling.khop_weighted(w, f, 4, 1)) == rows(sampling.khop_weighted(w, f, 4, 1, simple=True))


def test_walks_over_lists_that_know_the_next_degree(spark):
    edges = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (0, 1), (1, 2)] + [(9, 2)], "src long, dst long")  # 9 is a dead end
    adj = build.with_positions(edges)
    deg = build.degrees(spark.range(10).withColumnRenamed("id", "node_id"), edges)
    more = adj.join(deg.select(F.col("node_id").alias("src"), F.col("in_degree").alias("src_deg")), "src")
    f = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (1, 9)], "batch_key long, node_id long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(sampling.random_walk(adj, f, 4, 0.2, 6, 3)) == rows(sampling.random_walk(more, f, 4, 0.2, 6, 3)) != []


@pytest.mark.parametrize("whole", [True, False])
def test_alias_tables_equal_a_plain_loop(spark, whole):
    """Light slots are filled in order by heavy ones in order; the mass of each slot stays its weight's share."""
    r = random.Random(4)
    lists = {d: [float(r.choice([1, 1, 2, 7, 100, 0])) if whole else r.random() ** 3 for _ in range(n)] for d, n in enumerate([1, 2, 3, 10, 40, 200])}
    lists[0] = [3.0]
    lists[10] = [5.0] * 7
    rows = [(d, k, 1000 * d + k, w, len(ws)) for d, ws in lists.items() if sum(ws) for k, w in enumerate(ws)]
    got = weights.alias_table(spark.createDataFrame(rows, "dst long, pos long, src long, w double, deg long").repartition(3)).collect()
    for d, ws in lists.items():
        own = sorted((x for x in got if x["dst"] == d), key=lambda x: x["pos"])
        mass = {x["src"]: 0.0 for x in own}
        for x in own:
            assert -1e-12 <= x["prob"] <= 1 + 1e-12
            mass[x["src"]] += x["prob"] / len(ws)
            mass[x["alias"]] += (1 - x["prob"]) / len(ws)
        assert all(abs(mass[x["src"]] - x["w"] / sum(ws)) < 1e-9 for x in own), d
        keep, other = weights.alias_rows(np.array(ws))
        assert np.allclose(keep, [x["prob"] for x in own]) and [1000 * d + int(o) for o in other] == [x["alias"] for x in own] or not whole


def test_prefix_draws_take_the_first_position_that_reaches(spark):
    """Zero weights make equal sums: the first position of them is the one that can be drawn."""
    edges = spark.createDataFrame([(1, 0, 0.0), (2, 0, 2.0), (3, 0, 0.0), (4, 0, 1.0), (5, 1, 1.0)], "src long, dst long, w double")
    table = weights.prefix_table(edges)
    many = spark.createDataFrame([(b, d) for b in range(600) for d in (0, 1, 7)], "batch_key long, node_id long")
    rows = sampling.khop_prefix(table, many, 1, 3).collect()
    counts = {}
    for x in rows:
        counts[x["dst"], x["src"]] = counts.get((x["dst"], x["src"]), 0) + 1
    assert set(counts) == {(0, 2), (0, 4), (1, 5)} and counts[1, 5] == 600 and abs(counts[0, 2] - 400) < 60


def test_ranks_of_many_values_need_no_table_of_them(spark):
    r = random.Random(2)
    rows = [(k, r.random() if k % 3 else 0.5, k % 4) for k in range(3000)]
    df = spark.createDataFrame(rows, "node_id long, v double, g long").repartition(7)
    got = {x["node_id"]: x["rank"] for x in ranks.rank_by_value(df, "v", "node_id").collect()}
    assert got == {k: n for n, (k, *_) in enumerate(sorted(rows, key=lambda x: (-x[1], -x[0])))}
    got = {x["node_id"]: x["at"] for x in ranks.global_rank(df, [F.col("v").asc(), F.col("node_id").asc()], "at", ["g"]).collect()}
    for g in range(4):
        own = sorted((x for x in rows if x[2] == g), key=lambda x: (x[1], x[0]))
        assert [got[x[0]] for x in own] == list(range(len(own)))
    assert ranks.rank_by_value(df.limit(0), "v", "node_id").count() == 0


@pytest.mark.parametrize("wide", [256, 1])
def test_layers_of_any_width(spark, monkeypatch, wide):
    monkeypatch.setattr(layers, "WIDE", wide)
    edges = spark.createDataFrame([(1, 0, 1), (2, 0, 3), (0, 1, 2)], "src long, dst long, w long")
    feats = spark.createDataFrame([(k, [float(k), float(k * k), 1.0]) for k in range(3)], "node_id long, feat array<float>")
    mean = {r["node_id"]: r["out"] for r in layers.sage_mean(edges, feats).collect()}
    assert mean == {0: [1.5, 2.5, 1.0], 1: [0.0, 0.0, 1.0]}
    scores = spark.createDataFrame([(k, [0.1 * k, -1.0 * k], [0.2, 0.3]) for k in range(3)], "node_id long, left array<double>, right array<double>")
    both = {r["node_id"]: r["out"] for r in layers.attention(edges, feats, scores).collect()}
    for h in range(2):
        one = {r["node_id"]: r["out"] for r in layers.attention(edges, feats, scores.select("node_id", F.col("left")[h].alias("left"), F.col("right")[h].alias("right"))).collect()}
        assert {k: v[3 * h : 3 * h + 3] for k, v in both.items()} == one


def test_a_graph_is_built_once(spark):
    """Later calls read written buckets: no query plan scans the business tables for edges again."""
    from meshweave.plans import query_samples
    from meshweave.sources import market

    sf = "/root/testdata/sf0.001"
    market.forget(spark, sf)
    first = market.market(spark, sf)
    assert market.market(spark, sf).num_nodes == first.num_nodes
    plan = query_samples.c8_visit_topk(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and "o_custkey" not in plan
    rows = sorted(map(tuple, market.build_market(spark, sf).edges.collect()))
    assert sorted(map(tuple, first.edges.select("src", "dst").collect())) == rows
    market.forget(spark, sf)
    assert sorted(map(tuple, market.market(spark, sf).edges.select("src", "dst").collect())) == rows
