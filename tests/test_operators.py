"""Operators on tiny graphs: edge cases, invariants and sampling laws."""

import math

import numpy as np
import random

import pytest
from pyspark.sql import functions as F

from meshweave.operators import access, analytics, batching, blocks, build, cache, checks, gather, layers, metrics, sampling, weights


@pytest.fixture(scope="module")
def star(spark):
    """Hub 0 with six in-neighbours, node 1 with two, node 7 alone."""
    return spark.createDataFrame([(i, 0) for i in range(1, 7)] + [(2, 1), (3, 1)], "src long, dst long")


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.range(8).select(F.col("id").alias("node_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("feat"), (F.col("id") % 3).alias("label"))


def seeds(spark, *ids, batch=0):
    return spark.createDataFrame([(batch, i, p) for p, i in enumerate(ids)], "batch_key long, node_id long, pos long")


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("fanout", [1, 2, 6, 9])
def test_khop_takes_min_of_degree_and_fanout(spark, star, fanout):
    s = got(sampling.khop(star, seeds(spark, 0, 1, 7), fanout, 1), "dst", "src")
    edges = {(d, a) for a, d in got(star, "src", "dst")}
    assert set(s) <= edges and len(s) == len(set(s)) == min(6, fanout) + min(2, fanout)


def test_khop_samples_positions_of_multi_edges(spark):
    dup = spark.createDataFrame([(1, 0)] * 3 + [(2, 0)], "src long, dst long")
    assert len(got(sampling.khop(dup, seeds(spark, 0), 4, 1), "src")) == 4


def test_khop_is_uniform(spark, star):
    many = spark.createDataFrame([(b, 0, 0) for b in range(3000)], "batch_key long, node_id long, pos long")
    counts = [n for _, n in got(sampling.khop(star, many, 2, 5).groupBy("src").count(), "src", "count")]
    expected = 3000 * 2 / 6
    assert sum((c - expected) ** 2 / expected for c in counts) < 20.5  # chi-square, 5 degrees, p = 0.001


def test_replacing_samplers_follow_their_weights(spark):
    edges = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0), (3, 0, 8.0)], "src long, dst long, w double")
    table = weights.prefix_table(edges)
    assert got(table, "pos", "src", "w", "prefix") == [(0, 1, 1.0, 1.0), (1, 2, 1.0, 2.0), (2, 3, 8.0, 10.0)]
    many = spark.createDataFrame([(b, 0) for b in range(4000)], "batch_key long, node_id long")
    for sample in (sampling.khop_prefix(table, many, 1, 3), sampling.khop_alias(weights.alias_table(table), many, 1, 3), sampling.khop_weighted(edges, many, 1, 3)):
        share = {k: n / 4000 for k, n in got(sample.groupBy("src").count(), "src", "count")}
        assert abs(share[3] - 0.8) < 0.03 and abs(share[1] - 0.1) < 0.03


def test_alias_rows_keep_the_mass():
    w = np.random.default_rng(0).random(17) + 0.01
    keep, other = weights.alias_rows(w)
    mass = keep / 17
    np.add.at(mass, other, (1 - keep) / 17)
    assert np.allclose(mass, w / w.sum())


def test_uniform_with_replacement_is_distinct(spark, star):
    s = got(sampling.khop_replace(build.with_positions(star), seeds(spark, 0, 7), 50, 1), "dst", "src")
    assert len(s) == len(set(s)) <= 6


def test_walks_stop_at_dead_ends_and_by_restart(spark):
    chain = build.with_positions(spark.createDataFrame([(1, 0), (2, 1)], "src long, dst long"))
    never = got(sampling.random_walk(chain, seeds(spark, 0, 2), 5, 0.0, 3, 1), "seed_id", "walk", "step", "node_id")
    assert never == [(0, w, s, s + 1) for w in range(3) for s in range(2)]
    always = got(sampling.random_walk(chain, seeds(spark, 0), 5, 1.0, 3, 1), "step", "node_id")
    assert always == [(0, 1)] * 3


def test_visit_topk_breaks_ties_by_id(spark):
    v = spark.createDataFrame([(0, 9, n) for n in (4, 4, 2, 2, 3)], "batch_key long, seed_id long, node_id long")
    assert got(sampling.visit_topk(v, 2), "src", "w") == [(2, 2), (4, 2)]


def test_blocks_have_the_prefix_property(spark, star):
    r = blocks.sample_blocks(seeds(spark, 7, 0, 1), [lambda f, layer: sampling.khop(star, f, 2, 1, layer)] * 2)
    ids = got(r.id_map, "local_id", "reached", "node_id")
    assert [i for i, _, _ in ids] == list(range(len(ids))) and [n for _, _, n in ids[:3]] == [7, 0, 1]
    assert [x for _, x, _ in ids] == sorted(x for _, x, _ in ids)
    back = {i: n for i, _, n in ids}
    edges = {(a, d) for a, d in got(star, "src", "dst")}
    assert all((back[row], back[col]) in edges for row, col in got(r.blocks, "row", "col"))


def test_fill_duplicates_goes_on_from_the_known(spark):
    known = blocks.fill_unique(seeds(spark, 5, 3))
    new = spark.createDataFrame([(0, 3, 0), (0, 9, 1), (0, 4, 2), (0, 9, 3)], "batch_key long, node_id long, pos long")
    assert got(blocks.fill_duplicates(known, new), "local_id", "node_id") == [(0, 5), (1, 3), (2, 9), (3, 4)]
    assert got(blocks.to_global(blocks.fill_duplicates(known, new).select("batch_key", "local_id"), known), "node_id") == [(3,), (5,)]


@pytest.mark.parametrize("drop_last, steps", [(False, 3), (True, 2)])
def test_batches(spark, drop_last, steps):
    b = batching.make_batches(spark.range(10).select(F.col("id").alias("node_id")), 2, 4, 1, drop_last)
    rows = got(b, "epoch", "step", "pos", "node_id")
    per = [[n for e, _, _, n in rows if e == k] for k in (0, 1)]
    assert all(len(set(p)) == len(p) == min(10, steps * 4) for p in per) and per[0] != per[1]
    assert {s for _, s, _, _ in rows} == set(range(steps))
    assert batching.split_steps(10, 3) == [(0, 3), (3, 6), (6, 10)]


def test_cache_hits_and_misses_make_up_the_inputs(spark, star, nodes):
    deg = build.degrees(nodes, star)
    c = cache.build_cache(cache.rank_degree(deg), 8, 0.25)
    assert [n for n, _ in sorted(got(c, "node_id", "cache_pos"), key=lambda x: x[1])] == [3, 2]
    ids = seeds(spark, 2, 3, 4, 99)
    for rows in (None, 2):
        out = gather.cached_gather(nodes, c.join(nodes.select("node_id", "feat"), "node_id"), ids, "feat", cached_rows=rows)
        assert got(out.select("node_id", "is_hit", F.col("feat")[0].alias("x")), "node_id", "is_hit", "x") == [(2, True, 2.0), (3, True, 3.0), (4, False, 4.0), (99, False, None)]
    assert got(gather.hit_rate(gather.cache_split(ids, c)), "num_input", "num_hit", "hit_rate") == [(4, 2, 0.5)]


def test_hit_curve(spark):
    freq = spark.createDataFrame([(0, 5), (1, 3), (2, 1), (3, 1)], "node_id long, freq long")
    curve = dict(got(access.hit_curve(freq, 4), "percent", "hit"))
    assert (curve[0], curve[25], curve[50], curve[75], curve[100]) == (0.0, 0.5, 0.8, 0.9, 1.0)
    assert all(curve[p] <= curve[p + 1] for p in range(100))


def test_policies_order(spark, star, nodes):
    """A cache by real counts never hits less than one by presampling, nor that less than a random one on a skewed graph."""
    rng = np.random.default_rng(2)
    edges = spark.createDataFrame([(int(min(199, rng.zipf(1.6))), int(rng.integers(0, 200))) for _ in range(3000)], "src long, dst long").distinct().cache()
    all_nodes = spark.range(200).select(F.col("id").alias("node_id"))
    b = batching.make_batches(all_nodes.where("node_id % 4 = 0"), 3, 10, 1)
    r = blocks.sample_blocks(b.select("batch_key", "node_id", "pos"), [lambda f, layer: sampling.khop(edges, f, 4, 1, layer)]).inputs()
    log = r.join(b.select("batch_key", "epoch").distinct(), "batch_key").cache()
    real = log.where("epoch > 0")
    rate = {}
    for name, ranking in (("optimal", cache.rank_presample(all_nodes, real)), ("presample", cache.rank_presample(all_nodes, log.where("epoch = 0"))), ("random", cache.rank_random(all_nodes, 1))):
        rate[name] = gather.hit_rate(gather.cache_split(real.select("batch_key", "node_id"), cache.build_cache(ranking, 200, 0.1))).first()["hit_rate"]
    assert rate["optimal"] >= rate["presample"] > rate["random"]


def test_checks_find_faults(spark, nodes):
    bad = spark.createDataFrame([(0, 9), (1, 1), (1, 2), (1, 2)], "src long, dst long")
    assert checks.id_range(bad, 8).first()["in_range"] is False
    assert got(checks.endpoints_outside(bad, nodes), "node_id") == [(9,)]
    assert got(checks.duplicate_edges(bad), "src", "dst", "copies") == [(1, 2, 2)]
    assert checks.self_loops(bad).count() == 1 and checks.reciprocal_edges(bad).count() == 1
    assert checks.sentinels(spark.createDataFrame([(4294967295,), (None,), (1,)], "node_id long")).count() == 2
    faults = checks.batch_faults(spark.createDataFrame([(0, 1), (0, 1), (0, None)], "batch_key long, node_id long")).first()
    assert (faults["num_rows"], faults["num_distinct"], faults["num_sentinel"]) == (3, 1, 1)


def test_degrees_offsets_and_histogram(spark, star, nodes):
    deg = build.degrees(nodes, star)
    assert got(deg.where("node_id < 3"), "node_id", "in_degree", "out_degree") == [(0, 6, 0), (1, 2, 1), (2, 0, 2)]
    assert got(build.offsets(deg, width=3), "node_id", "offset")[:4] == [(0, 0), (1, 6), (2, 8), (3, 8)]
    h = got(analytics.degree_histogram(deg), "degree", "cum_edge_pct")
    assert h[-1] == (6, 75.0) and h[0] == (0, 100.0)


def test_reach_goes_to_the_fixpoint(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(6)] + [(0, 6)], "src long, dst long")
    r = analytics.reach_by_hop(chain, spark.createDataFrame([(0,)], "node_id long"))
    assert got(r, "node_id", "hop") == [(i, i) for i in range(7)]


def test_expected_visits_by_hand(spark):
    edges = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "src long, dst long")
    all_nodes = spark.range(4).select(F.col("id").alias("node_id"))
    v = dict(got(cache.expected_visits(edges, build.degrees(all_nodes, edges), all_nodes.where("node_id = 0"), (1, 1)), "node_id", "visits"))
    assert v[0] == 1.0 and all(math.isclose(v[k], 0.5) for k in (1, 2, 3))


def test_layers_by_hand(spark):
    feats = spark.createDataFrame([(0, [3.0, 4.0]), (1, [1.0, 0.0]), (2, [3.0, 2.0])], "node_id long, feat array<float>")
    edges = spark.createDataFrame([(1, 0, 1), (2, 0, 3)], "src long, dst long, w long")
    assert layers.sage_mean(edges, feats).first()["out"] == [2.0, 1.0]
    assert layers.gcn(edges, feats).first()["out"] == [pytest.approx(4 / math.sqrt(2), abs=1e-6), pytest.approx(2 / math.sqrt(2), abs=1e-6)]
    pin = layers.pin_sage(edges, feats).first()["out"]
    assert pin == pytest.approx([x / math.sqrt(9 + 16 + 6.25 + 2.25) for x in (3, 4, 2.5, 1.5)], abs=1e-6)
    p = got(layers.segment_softmax(spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 5.0)], "k long, x double"), "k", "x"), "k", "p")
    assert p == [(0, 0.5), (0, 0.5), (1, 1.0)]
    out = layers.dense(spark.createDataFrame([([1.0, -2.0],)], "out array<double>"), [[1.0, 1.0], [2.0, 0.0]], [0.0, 1.0], relu=True).first()["out"]
    assert out == [0.0, 3.0]


def test_mean_leaves_out_the_first_key(spark):
    log = spark.createDataFrame([("a", 0, 100.0), ("a", 1, 2.0), ("a", 2, 4.0), ("b", 0, 5.0)], "item string, key long, val double")
    assert got(metrics.mean_after_first(log), "item", "mean") == [("a", 3.0), ("b", 0.0)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_expected_visits_equal_a_loop_over_paths(spark, seed):
    """Leaves, seeds with one neighbour, nodes that are their own neighbours, and lists longer than the fanouts."""
    r = random.Random(seed)
    pairs = {(r.randrange(12), r.randrange(12)) for _ in range(30)} | {(12 + k, r.randrange(12)) for k in range(6)} | {(r.randrange(12), 18 + k) for k in range(6)} | {(3, 3), (12, 12), (20, 20)}
    lists = {d: sorted(s for s, e in pairs if e == d) for d in range(24)}
    train = [*range(0, 12, 2), *range(12, 24)]
    want = {}
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
    edges, nodes = spark.createDataFrame(sorted(pairs), "src long, dst long"), spark.range(24).withColumnRenamed("id", "node_id")
    seeds = spark.createDataFrame([(s,) for s in train], "node_id long")
    for simple in (True, False):
        got = dict(map(tuple, cache.expected_visits(edges, build.degrees(nodes, edges), seeds, (3, 2), simple).collect()))
        assert got == pytest.approx(want, abs=1e-9)
