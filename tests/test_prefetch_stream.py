"""The dynamic cache on a stream against its batch form: order, parts, late rows, batches that never come, restarts."""

import datetime

import pytest
from pyspark.sql import functions as F

from meshweave.operators import blocks, gather, sampling
from meshweave.plans.session import prepare
from meshweave.streaming import prefetch

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
BATCHES = 6


def minute(k):
    return START + datetime.timedelta(minutes=k)


@pytest.fixture(scope="module")
def graph(spark):
    prepare(spark)
    edges = spark.createDataFrame([((i * 7 + k) % 60, i) for i in range(60) for k in range(i % 7)], "src long, dst long").cache()
    nodes = spark.range(60).select(F.col("id").alias("node_id"), (F.col("id") * 2).alias("feat"))
    return edges, nodes


def hops(edges):
    return [lambda f, layer: sampling.khop(edges, f, 3, 1, layer, simple=True)] * 2


def seeds(keys):
    """Rows of SEEDS of the batches, five nodes each; batch k is of minute k."""
    return [(k, (k * 11 + p * 5) % 60, p, minute(k)) for k in keys for p in range(5)]


def batch_form(spark, edges, keys=range(BATCHES)):
    f = spark.createDataFrame(seeds(keys), prefetch.SEEDS).drop("ts")
    _, reached = blocks.sample_layers(f, hops(edges))
    near = blocks.prefetch_set(edges, reached.where("reached < 2"))
    got = gather.dynamic_gather(spark.range(60).select(F.col("id").alias("node_id"), (F.col("id") * 2).alias("feat")), reached.select("batch_key", "node_id"), near, "feat")
    return sorted(tuple(r) for r in got.select("batch_key", "node_id", "is_hit", "feat").collect())


class Run:
    """Feeds files of seeds, one after the other, into both queries."""

    def __init__(self, spark, graph, root, **options):
        self.spark, (self.edges, self.nodes), self.root, self.options, self.files = spark, graph, root, {"late": "2 minutes", "buckets": 2} | options, 0

    def feed(self, rows):
        self.files += 1
        self.spark.createDataFrame(rows, prefetch.SEEDS).coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        stream = self.spark.readStream.schema(prefetch.SEEDS).parquet(f"{self.root}/in")
        prefetch.sample_stream(stream, self.edges, hops(self.edges), f"{self.root}/touched", f"{self.root}/state1")
        out = prefetch.decide_stream(self.spark, f"{self.root}/touched", self.nodes, f"{self.root}/out", f"{self.root}/state2", "feat", **self.options)
        return sorted(tuple(r) for r in out.collect())


def test_batches_out_of_order_and_in_parts(spark, graph, tmp_path):
    run = Run(spark, graph, f"file://{tmp_path}")
    assert run.feed(seeds([1])) == []  # nothing is due before the watermark says so
    run.feed(seeds([0])[:2])
    run.feed(seeds([0])[2:] + seeds([2])[:3])
    got = run.feed(seeds([2])[2:] + seeds([4]))  # a row of batch 2 comes twice
    assert {r[0] for r in got} <= {0, 1, 2}
    want = batch_form(spark, graph[0])
    odd = [(None, 3, 0, None), (7, 3, 0, None), (7, None, 0, minute(5))]  # without a time or a node: left out
    got = run.feed(seeds([3, 5]) + [(None, None, None, minute(1000))] + odd)  # a heartbeat beside seeds
    assert got == want and {r[2] for r in want} == {True, False}


def test_late_batches_are_dropped(spark, graph, tmp_path):
    run = Run(spark, graph, f"file://{tmp_path}")
    run.feed(seeds([0, 2]))
    run.feed(seeds([9]))
    got = run.feed(seeds([1]) + seeds([10]) + [(None, None, None, minute(1000))])  # minute 1 is over: the watermark is at minute 7
    want = batch_form(spark, graph[0], [0, 2, 9, 10])
    assert got == want
    assert not any(r[2] for r in got if r[0] == 2)


def test_what_is_kept_too_long_is_forgotten(spark, graph, tmp_path):
    run = Run(spark, graph, f"file://{tmp_path}", keep="3 minutes")
    late = [(k, v, p, minute(20)) for k, v, p, _ in seeds([1])]
    run.feed(seeds([0]) + [(None, None, None, minute(10))])  # the watermark passes what batch 0 had loaded ahead
    got = run.feed(late + [(None, None, None, minute(1000))])
    assert {r[0] for r in got} == {0, 1} and not any(r[2] for r in got)
    kept = Run(spark, graph, f"file://{tmp_path}/kept", keep="1 hour")
    kept.feed(seeds([0]) + [(None, None, None, minute(10))])
    assert kept.feed(late + [(None, None, None, minute(1000))]) == batch_form(spark, graph[0], [0, 1])


def test_a_sampling_that_fails_is_done_again(spark, graph, tmp_path, monkeypatch):
    run = Run(spark, graph, f"file://{tmp_path}")
    run.feed(seeds([0, 1]))
    real = prefetch.touched

    def partly(part, edges, hops):
        """Writes what it has, then fails: the folder of the trigger is there, half done."""
        real(part, edges, hops).limit(3).write.mode("overwrite").parquet(f"file://{tmp_path}/touched/trigger=1")
        raise RuntimeError("lost")

    monkeypatch.setattr(prefetch, "touched", partly)
    with pytest.raises(Exception):
        run.feed(seeds([2, 3]))
    monkeypatch.setattr(prefetch, "touched", real)
    assert run.feed(seeds([4, 5]) + [(None, None, None, minute(1000))]) == batch_form(spark, graph[0])
