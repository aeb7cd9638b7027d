"""The dynamic cache on a stream whose state holds a batch's own nodes, not all that they load ahead."""

from pyspark.sql import functions as F

from meshweave.streaming import prefetch
from tests.test_prefetch_stream import batch_form, graph, hops, minute, seeds

__all__ = ["graph"]


class Run:
    def __init__(self, spark, graph, root):
        self.spark, (self.edges, self.nodes), self.root = spark, graph, root

    def feed(self, rows, **options):
        self.spark.createDataFrame(rows, prefetch.SEEDS).coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        stream = self.spark.readStream.schema(prefetch.SEEDS).parquet(f"{self.root}/in")
        prefetch.sample_stream(stream, self.edges, hops(self.edges), f"{self.root}/touched", f"{self.root}/state1", expand=False)
        out = prefetch.decide_stream(self.spark, f"{self.root}/touched", self.nodes, f"{self.root}/out", f"{self.root}/state2", "feat", late="2 minutes", edges=self.edges, **options)
        return sorted(tuple(r) for r in out.collect())


def test_order_parts_and_late_batches(spark, graph, tmp_path):
    """As in the form with all nodes in state: parts, another order, and a batch that comes too late to count."""
    run = Run(spark, graph, f"file://{tmp_path}")
    assert run.feed(seeds([1]) + seeds([0])[:2]) == []
    run.feed(seeds([0])[2:] + seeds([2]))
    rows = spark.read.schema(prefetch.TOUCHED).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/touched")
    near, own = rows.where("near").count(), rows.where("not near").count()
    assert 0 < near <= own  # lists are not written out
    run.feed(seeds([9]))
    got = run.feed(seeds([5]) + seeds([10]) + [(None, None, None, minute(1000))])  # minute 5 is over
    assert got == batch_form(spark, graph[0], [0, 1, 2, 9, 10]) and {r[2] for r in got} == {True, False}


def test_sources_without_inputs_are_forgotten(spark, graph, tmp_path):
    run = Run(spark, graph, f"file://{tmp_path}")
    late = [(k, v, p, minute(20)) for k, v, p, _ in seeds([1])]
    run.feed(seeds([0]) + [(None, None, None, minute(10))], keep="3 minutes")
    got = run.feed(late + [(None, None, None, minute(1000))], keep="3 minutes")
    assert {r[0] for r in got} == {0, 1} and not any(r[2] for r in got)
