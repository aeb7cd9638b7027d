"""The engine object under every sample type and cache policy."""

import pytest
from pyspark.sql import functions as F

from meshweave.plans import session_api as api
from meshweave.plans.session import ship_package
from meshweave.sources.market import market

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    ship_package(spark)
    return market(spark, SF)


@pytest.mark.parametrize("kind", api.SAMPLE_TYPES)
def test_blocks_of_every_sample_type(graph, kind):
    s = api.Sampler(graph, api.SamplerConfig(sample_type=kind, batch_size=8, fanout=(4, 3), seed=1))
    r = s.sample(s.batches().where("batch_key < 2"))
    edges = {(a, b) for a, b in graph.edges.select("src", "dst").collect()}
    rows = r.edges.collect()
    if kind != "random_walk":
        assert all((x["src"], x["dst"]) in edges for x in rows)
    per = {}
    for x in rows:
        per[x["batch_key"], x["layer"], x["dst"]] = per.get((x["batch_key"], x["layer"], x["dst"]), 0) + 1
    assert rows and all(n <= (3 if layer == 0 else 4) for (_, layer, _), n in per.items())
    assert r.blocks.count() == len(rows)
    ids = r.id_map.groupBy("batch_key").agg(F.count("*").alias("n"), F.max("local_id").alias("m")).collect()
    assert all(x["n"] == x["m"] + 1 for x in ids)
    feats, labels = s.load_subtensor(r)
    assert feats.where("feat is null").count() == 0 and labels.count() == 16


@pytest.mark.parametrize("policy", api.CACHE_POLICIES)
def test_every_cache_policy(graph, policy):
    s = api.Sampler(graph, api.SamplerConfig(batch_size=10, fanout=(3, 2), cache_policy=policy, cache_percentage=0.2, seed=1))
    r = s.sample()
    if policy != "dynamic_cache":
        ranks = sorted(x["rank"] for x in s.ranking().collect())
        assert ranks == list(range(graph.num_nodes))
        hits = s.hit_rate(r).first()
        assert 0 <= hits["hit_rate"] <= 1 and s.cached_features(r).count() == hits["num_input"]
    else:
        assert s.hit_rate(r).where("num_hit > num_input").count() == 0
        with pytest.raises(ValueError):
            s.ranking()


def test_metadata_and_reports(graph):
    s = api.Sampler(graph, api.SamplerConfig(batch_size=8, num_epoch=2, fanout=(2,)))
    assert (s.num_epoch(), s.steps_per_epoch, s.num_class(), s.feat_dim()) == (2, 3, 10, 64)
    r = s.sample()
    assert s.report_node_access(r).count() == r.inputs().select("node_id").distinct().count()


def test_settings():
    c = api.SamplerConfig.from_settings({"_sample_type": "khop2", "batch_size": "100", "num_epoch": "3", "fanout": "5 10 15", "_cache_policy": "degree", "cache_percentage": "0.2", "sampler_ctx": "cuda:0"})
    assert (c.fanout, c.batch_size, c.cache_percentage) == ((5, 10, 15), 100, 0.2)
    walk = {"sample_type": "random_walk", "batch_size": 1, "num_epoch": 1, "random_walk_length": 3, "random_walk_restart_prob": 0.5, "num_random_walk": 4, "num_neighbor": 5, "num_layer": 3}
    assert api.SamplerConfig.from_settings(walk).fanout == (5, 5, 5)
    for bad in ({"sample_type": "khop2"}, {**walk, "num_layer": None, "sample_type": "x", "fanout": "1"}, {k: v for k, v in walk.items() if k != "num_layer"}):
        with pytest.raises(ValueError):
            api.SamplerConfig.from_settings(bad)
