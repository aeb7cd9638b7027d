"""Views and table functions; caches told by bits."""

import pytest
from pyspark.sql import functions as F

from meshweave.operators import gather, sampling
from meshweave.plans import sql_surface
from meshweave.plans.session import prepare
from meshweave.sources.market import Graph


@pytest.fixture(scope="module")
def graph(spark):
    prepare(spark)
    edges = spark.createDataFrame([((i * 13 + k * k) % 90, i) for i in range(90) for k in range(i % 15)] + [(i, 7) for i in range(90)], "src long, dst long")
    nodes = spark.range(90).select(F.col("id").alias("node_id"))
    g = Graph(nodes, edges, nodes.limit(5).withColumn("split", F.lit("train")), 90)
    sql_surface.register(spark, g, "g")
    spark.range(270).select((F.col("id") % 3).alias("batch_key"), (F.col("id") % 90).alias("node_id")).distinct().createOrReplaceTempView("asked")
    return g


def test_the_function_samples_as_the_sampler_does(spark, graph):
    df = spark.sql("SELECT * FROM sample_neighbours(TABLE(SELECT f.batch_key, l.dst, l.pos, l.src, l.deg FROM asked f JOIN g_lists l ON l.dst = f.node_id) PARTITION BY (batch_key, dst), 4, 11)")
    want = sampling.khop_places(spark.table("g_lists"), spark.table("asked"), 4, 11)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.select("batch_key", "dst", "src").collect())) and df.count() > 200
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(batch_key" in plan and "UDTF" in plan


def test_views(spark, graph):
    assert spark.table("g_nodes").count() == 90 and spark.table("g_splits").count() == 5
    told = spark.sql("SELECT count(*) n, sum(in_degree) e FROM g_degrees").first()
    assert tuple(told) == (90, spark.table("g_edges").count())
    assert sql_surface.places(0, 7, 3, 10, 1) == {0, 1, 2} and len(sql_surface.places(0, 7, 1000, 10, 1)) == 10


def test_bits_tell_hits(spark, monkeypatch):
    ids = [0, 1, 2, 7, 8, 9, 32767, 32768, 32769, 65536, 65537, 10**12, 10**12 + 1]
    cached = spark.createDataFrame([(v, k) for k, v in enumerate(ids[::2])], "node_id long, cache_pos long")
    asked = spark.createDataFrame([(b, v) for b in range(2) for v in [*ids, 5]] + [(0, None)], "batch_key long, node_id long")
    want = sorted(((b, v, ids[::2].index(v) if v in ids[::2] else None, v in ids[::2]) for b in range(2) for v in [*ids, 5]), key=repr)
    monkeypatch.setattr(gather, "BROADCAST_ROWS", 3)
    for most in (64 << 20, 0):
        monkeypatch.setattr(gather, "BITMAP_BYTES", most)
        split = gather.cache_split(asked, cached, 7)
        got = sorted(map(tuple, split.where("node_id is not null").collect()), key=repr)
        assert got == want and split.where("node_id is null and not is_hit").count() == 1
    flags = gather.hit_flags(asked, gather.cached_bitmaps(cached), 5)
    assert "cache_pos" not in flags.columns and flags.where("is_hit").count() == 14


def test_misses_of_a_large_cache_do_not_meet_its_places(spark, monkeypatch):
    monkeypatch.setattr(gather, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(gather, "BITMAP_BYTES", 64 << 20)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ids = spark.range(1000).select(F.lit(0).cast("long").alias("batch_key"), F.col("id").alias("node_id"))
        split = gather.cache_split(ids, spark.range(0, 100_000, 7).select(F.col("id").alias("node_id"), (F.col("id") / 7).cast("long").alias("cache_pos")), 14_286)
        plan = split._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and "BroadcastHashJoin" in plan and split.where("is_hit").count() == 143 and split.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
