"""Validation: ranges, duplicates, loops, symmetry, order; each returns rows that say what is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SENTINEL = 4294967295


def id_range(edges: DataFrame, num_nodes: int) -> DataFrame:
    top = F.max(F.greatest("src", "dst"))
    return edges.agg(top.alias("max_id"), (top < num_nodes).alias("in_range"))


def offsets_fit(indptr: DataFrame, num_nodes: int, num_edges: int) -> DataFrame:
    """One row: whether offsets (pos, value) start at 0, never fall and end at num_edges, with the places where they fall."""
    nxt = indptr.select((F.col("pos") - 1).alias("pos"), F.col("value").alias("end"))
    falls = indptr.join(nxt, "pos", "left").agg(
        F.count("*").alias("num_offset"), F.min(F.when(F.col("pos") == 0, F.col("value"))).alias("first"), F.min(F.when(F.col("pos") == num_nodes, F.col("value"))).alias("last"),
        F.coalesce(F.sum((F.col("end") < F.col("value")).cast("long")), F.lit(0)).alias("num_fall"),
    )
    fine = (F.col("num_offset") == num_nodes + 1) & (F.col("first") == 0) & (F.col("last") == num_edges) & (F.col("num_fall") == 0)
    return falls.select("*", F.coalesce(fine, F.lit(False)).alias("fits"))


def row_counts(edges: DataFrame, expected: int) -> DataFrame:
    return edges.agg(F.count("*").alias("num_edge"), (F.count("*") == expected).alias("matches"))


def endpoints_outside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge ends that are no node, with their number of uses."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count("*").alias("uses")).join(nodes.select("node_id"), "node_id", "left_anti")


def duplicate_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count("*").alias("copies")).where("copies > 1")


def reciprocal_edges(edges: DataFrame) -> DataFrame:
    """Edges whose opposite is there too."""
    other = edges.select(F.col("dst").alias("a"), F.col("src").alias("b")).distinct()
    return edges.join(other, (F.col("src") == F.col("a")) & (F.col("dst") == F.col("b")), "left_semi")


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst")


def without_neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("node_id").join(edges.select(F.col("dst").alias("node_id")), "node_id", "left_anti")


def unsorted_lists(adj: DataFrame) -> DataFrame:
    """Nodes whose list is out of order at some position."""
    before = F.lag("src").over(Window.partitionBy("dst").orderBy("pos"))
    return adj.withColumn("before", before).where("before > src").select("dst").distinct()


def sentinels(ids: DataFrame) -> DataFrame:
    return ids.where((F.col("node_id") == SENTINEL) | F.col("node_id").isNull())


def batch_faults(batches: DataFrame) -> DataFrame:
    """Per batch: rows, distinct nodes, missing or sentinel nodes."""
    bad = (F.col("node_id").isNull() | (F.col("node_id") == SENTINEL)).cast("long")
    once = batches.groupBy("batch_key", "node_id").agg(F.count("*").alias("n"), F.sum(bad).alias("bad"))
    return once.groupBy("batch_key").agg(F.sum("n").alias("num_rows"), F.count("node_id").alias("num_distinct"), F.sum("bad").alias("num_sentinel"))
