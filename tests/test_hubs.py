"""A node with a third of all edges: the range-wise scans, cut into small ranges, give what the plain ones give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.operators import build, sampling, weights


@pytest.fixture(scope="module")
def hub(spark):
    rng = np.random.default_rng(2)
    edges = [(int(s), 0) for s in rng.integers(0, 5000, 900)] + [(int(s), int(d)) for s, d in zip(rng.integers(0, 5000, 1800), rng.integers(1, 60, 1800))]
    w = rng.choice([1.0, 1.0, 2.0, 100.0, 0.0], len(edges))
    return spark.createDataFrame([(s, d, float(x)) for (s, d), x in zip(edges, w)], "src long, dst long, w double").dropDuplicates(["src", "dst"]).repartition(6).cache()


@pytest.fixture(autouse=True)
def small_ranges(spark):
    """Many ranges, so that a list crosses their borders."""
    keys = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def same(a, b, cols):
    rows = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect()))
    assert rows(a) == rows(b)


def test_positions(spark, hub):
    plain, ranged = build.with_positions(hub), build.with_positions(hub, hubs=True)
    same(plain, ranged, ["dst", "pos", "src", "deg"])
    # no task has the hub's list: ranges are cut by the source too
    longest = hub.where("dst = 0").count()
    parts = hub.repartitionByRange(23, "dst", "src").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert longest > hub.count() / 4 and parts < longest / 2


def test_prefix_and_alias_tables(spark, hub):
    plain, ranged = weights.prefix_table(hub), weights.prefix_table(hub, hubs=True)
    same(plain, ranged, ["dst", "pos", "src", "w", "prefix", "deg"])
    some = plain.join(plain.groupBy("dst").agg(F.sum("w").alias("all")).where("all > 0"), "dst")
    same(weights.alias_table(some), weights.alias_table(some, hubs=True), ["dst", "pos", "src", "w", "deg", "prob", "alias"])
    # the plain loop over the hub's list
    rows = some.where("dst = 0").orderBy("pos").collect()
    keep, other = weights.alias_rows(np.array([r["w"] for r in rows]))
    got = weights.alias_table(some, hubs=True).where("dst = 0").orderBy("pos").collect()
    assert np.allclose([r["prob"] for r in got], keep) and [r["alias"] for r in got] == [rows[i]["src"] for i in other]


def test_prefix_draws(spark, hub):
    table = weights.prefix_table(hub.where("w > 0"))
    seeds = spark.range(12).select(F.col("id").alias("batch_key"), F.lit(0).cast("long").alias("node_id")).unionAll(spark.range(60).select(F.lit(3).cast("long"), "id"))
    same(sampling.khop_prefix(table, seeds, 9, 5), sampling.khop_prefix(table, seeds, 9, 5, hubs=True), ["batch_key", "dst", "src"])


def test_lists_in_chunks(spark, hub):
    adj = build.with_positions(hub)
    rows = build.chunked_lists(adj, 50).collect()
    assert max(len(r["neighbours"]) for r in rows) == 50
    whole = {r["dst"]: r["neighbours"] for r in build.adjacency_lists(hub).collect()}
    joined = {}
    for r in sorted(rows, key=lambda r: (r["dst"], r["chunk"])):
        joined.setdefault(r["dst"], []).extend(r["neighbours"])
    assert joined == whole


def test_the_engine_turns_it_on_by_itself(spark, hub, monkeypatch):
    from meshweave.plans.session_api import Sampler, SamplerConfig
    from meshweave.sources.market import Graph

    monkeypatch.setattr(build, "HUB_EDGES", 500)
    nodes = spark.range(5000).select(F.col("id").alias("node_id"))
    splits = spark.range(40).select(F.col("id").alias("node_id"), F.lit("train").alias("split"))
    graph = Graph(nodes, hub.select("src", "dst"), splits, 5000)
    for kind in ("khop0", "weighted_khop", "weighted_khop_prefix"):
        with_hubs = Sampler(graph, SamplerConfig(sample_type=kind, batch_size=20, fanout=(3,)))
        plain = Sampler(graph, SamplerConfig(sample_type=kind, batch_size=20, fanout=(3,)))
        plain.__dict__["hubs"] = False
        assert with_hubs.hubs
        same(with_hubs.sample().edges, plain.sample().edges, ["batch_key", "dst", "src"])
    with_hubs.log_sizes(with_hubs.sample())
    assert "num_sample" in with_hubs.report_step(0, 0, 3) and with_hubs.get_log_step_value(0, 0, "last_layer_size") > 0
    with_hubs.register_item("step", "my_time", 2)
    with_hubs.log_step(0, 0, "my_time", 4)
    assert "my_time 4.0000" in with_hubs.report_step(0, 0, 2) and "my_time" not in with_hubs.report_step(0, 0, 1)
