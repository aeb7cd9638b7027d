"""Graphs for SQL callers: views over a graph's tables and table functions that sample from them.

    register(spark, graph, "market")
    spark.sql('''SELECT * FROM sample_neighbours(
        TABLE(SELECT f.batch_key, l.dst, l.pos, l.src, l.deg FROM frontier f JOIN market_lists l ON l.dst = f.node_id)
        PARTITION BY (batch_key, dst), 10, 42)''')
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from ..operators import build
from ..sources.market import Graph


def places(batch_key: int, dst: int, deg: int, fanout: int, seed: int, layer: int = 0) -> set[int]:
    """The positions that sampling.khop_places draws for one node of one batch."""
    taken: set[int] = set()
    for k in range(max(deg - fanout, 0), deg):
        drawn = int(hashlib.md5(f"{seed}:{batch_key}:{layer}:{dst}:{k}".encode()).hexdigest()[:8], 16) % (k + 1)
        taken.add(k if drawn in taken else drawn)
    return taken


class SampleNeighbours:
    """Uniform neighbours without replacement, of rows (batch_key, dst, pos, src, deg) in partitions by batch_key and dst.

    The first row of a list tells its length and so the places that are drawn; rows stream by, and no more than the places are held.
    """

    def __init__(self):
        self.wanted, self.at = None, None

    def eval(self, row: Row, fanout: int, seed: int, layer: int = 0):
        at = (row["batch_key"], row["dst"])
        if self.at != at:
            self.at, self.wanted = at, places(*at, row["deg"], fanout, seed, layer)
        if row["pos"] in self.wanted:
            yield row["batch_key"], row["dst"], row["src"]


def register(spark: SparkSession, graph: Graph, name: str) -> None:
    """Views name_nodes, name_edges, name_splits, name_lists, name_degrees, and the function sample_neighbours."""
    lists = graph.lists if graph.lists is not None else build.with_positions(graph.edges, graph.hubs)
    degrees = graph.degrees if graph.degrees is not None else build.degrees(graph.nodes, graph.edges)
    for part, df in (("nodes", graph.nodes), ("edges", graph.edges), ("splits", graph.splits), ("lists", lists), ("degrees", degrees)):
        df.createOrReplaceTempView(f"{name}_{part}")
    sample = F.udtf(SampleNeighbours, returnType="batch_key long, dst long, src long")
    spark.udtf.register("sample_neighbours", sample)
