"""Degree analytics, memory estimates and breadth-first reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import global_rank, rank_by_value
from ..plans.storage import materialise


def degree_histogram(deg: DataFrame, column: str = "in_degree") -> DataFrame:
    """Per degree, highest first: nodes, and running shares of nodes and edges."""
    per = deg.groupBy(F.col(column).alias("degree")).agg(F.count("*").alias("num_node"))
    every, upto = Window.partitionBy(), Window.orderBy(F.col("degree").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nodes, edges = F.col("num_node"), F.col("num_node") * F.col("degree")
    pct = lambda x, w: F.round(F.try_divide(F.sum(x).over(w) * 100.0, F.sum(x).over(every)), 6)
    own = lambda x: F.round(F.try_divide(x * 100.0, F.sum(x).over(every)), 6)
    return per.select("degree", "num_node", own(nodes).alias("node_pct"), pct(nodes, upto).alias("cum_node_pct"), own(edges).alias("edge_pct"), pct(edges, upto).alias("cum_edge_pct"))


def nodes_by_degree(deg: DataFrame) -> DataFrame:
    return rank_by_value(deg, "in_degree", "node_id", "place").select("place", "node_id", "in_degree")


def max_degrees(deg: DataFrame) -> DataFrame:
    return deg.agg(F.max("in_degree").alias("max_in_degree"), F.max("out_degree").alias("max_out_degree"))


def size_estimates(num_nodes: int, num_edges: int, dim: int, spark) -> DataFrame:
    """Bytes of topology (offsets and lists of 4-byte ids) and of 4-byte features."""
    one = spark.range(1).select(F.lit(num_nodes).cast("long").alias("n"), F.lit(num_edges).cast("long").alias("e"), F.lit(dim).cast("long").alias("d"))
    return one.select(((F.col("n") + 1 + F.col("e")) * 4).alias("topology_bytes"), (F.col("n") * F.col("d") * 4).alias("feature_bytes"))


#: Hops after which the tables of nodes reached are folded into one.
FOLD = 4


def reach_by_hop(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(node_id, hop): breadth-first distance along lists, to the fixpoint or max_hops.

    Each hop joins only the newest nodes with the lists and is written to the shared folder, which
    cuts the lineage; what returns to the driver is one count a hop. Nodes reached are one table and
    those of at most FOLD hops, however many hops there are.
    """
    new = materialise(seeds.select("node_id").distinct().withColumn("hop", F.lit(0)), "reach")
    known, hop = new, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        near = edges.join(new.select(F.col("node_id").alias("dst")), "dst").select(F.col("src").alias("node_id")).distinct()
        new = materialise(near.join(known, "node_id", "left_anti").withColumn("hop", F.lit(hop)), "reach")
        if new.isEmpty():
            break
        known = known.unionAll(new)
        if hop % FOLD == 0:
            known = materialise(known, "reach")
    return known


def first_part(seeds: DataFrame, parts: int, order: str = "pos") -> DataFrame:
    """The first floor(n / parts) seeds in the given order: what one of so many trainers would start from."""
    ranked = global_rank(seeds.select("node_id", F.col(order).alias("__order")), [F.col("__order"), F.col("node_id")])
    return ranked.where(F.col("rank") < seeds.count() // parts).select("node_id")


def reach_sizes(reach: DataFrame, num_nodes: int) -> DataFrame:
    """Per hop: nodes reached so far and their share."""
    per = reach.groupBy("hop").agg(F.count("*").alias("n"))
    upto = Window.orderBy("hop").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(upto)
    return per.select("hop", total.alias("num_node"), F.round(total * 100.0 / num_nodes, 6).alias("node_pct"))
