"""Cache rankings: which nodes' features to keep near."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import draw
from ..functions.ranks import global_rank, rank_by_draw, rank_by_value
from ..functions.selection import first_k
from .build import degrees, induced_rows
from .reach import path_hits
from .sampling import all_neighbour_frontier


def rank_degree(deg: DataFrame) -> DataFrame:
    """ranking(node_id, rank): out-degree, then id, both descending."""
    return rank_by_value(deg.select("node_id", "out_degree"), "out_degree", "node_id").select("node_id", "rank")


def rank_heuristic(nodes: DataFrame, edges: DataFrame, train: DataFrame, deg: DataFrame) -> DataFrame:
    """Training nodes first (by id), then their neighbours (by id), then the rest by degree."""
    first = train.select("node_id", F.lit(0).alias("tier"))
    near = edges.join(train.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node_id"), F.lit(1).alias("tier")).distinct()
    tiers = first.unionAll(near).groupBy("node_id").agg(F.min("tier").alias("tier"))
    rows = nodes.select("node_id").join(tiers, "node_id", "left").join(deg.select("node_id", "out_degree"), "node_id")
    rest = F.col("tier") == 2
    rows = rows.withColumn("tier", F.coalesce("tier", F.lit(2)))
    rows = rows.withColumn("k1", F.when(rest, -F.col("out_degree")).otherwise(F.lit(0).cast("long"))).withColumn("k2", F.when(rest, -F.col("node_id")).otherwise(F.col("node_id")))
    return global_rank(rows, [F.col("tier"), F.col("k1"), F.col("k2")]).select("node_id", "tier", "rank")


def rank_degree_hop(nodes: DataFrame, edges: DataFrame, train: DataFrame, deg: DataFrame, hops: int = 2) -> DataFrame:
    """Nodes within hops of the training set by their out-degree in the subgraph of touched lists, then the others by degree."""
    seeds = train.select(F.lit(0).alias("batch_key"), "node_id")
    touched = all_neighbour_frontier(edges, seeds, hops).select("node_id")
    sub = degrees(touched, induced_rows(edges, touched)).select("node_id", F.col("out_degree").alias("sub"))
    rows = deg.select("node_id", "out_degree").join(sub, "node_id", "left")
    rows = rows.withColumn("touched", F.col("sub").isNotNull().cast("int")).withColumn("value", F.coalesce("sub", "out_degree"))
    ranked = global_rank(rows, [F.col("touched").desc(), F.col("value").desc(), F.col("node_id").desc()])
    return ranked.select("node_id", F.col("touched").cast("boolean").alias("touched"), "rank")


def rank_presample(nodes: DataFrame, access: DataFrame) -> DataFrame:
    """Times each node was a batch input in the sampled epochs, then id, both descending; unseen nodes count 0."""
    return rank_frequency(nodes, access.groupBy("node_id").agg(F.count("*").alias("freq")))


def rank_frequency(nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """rank_presample from counts seen(node_id, freq)."""
    freq = nodes.select("node_id").join(seen, "node_id", "left").select("node_id", F.coalesce("freq", F.lit(0).cast("long")).alias("freq"))
    return rank_by_value(freq, "freq", "node_id").select("node_id", "freq", "rank")


def expected_visits(edges: DataFrame, deg: DataFrame, train: DataFrame, fanouts: tuple[int, int] = (25, 10), simple: bool = False) -> DataFrame:
    """(node_id, visits): expected times a node is reached when each training node is a batch of its own.

    A node reached in one hop is missed with 1 - min(1, f1 / deg); over two hops each path misses
    with 1 - hit1 * min(1, f0 / deg); misses multiply, and a seed always counts as one visit.

    simple says that no edge is there twice. Then a node in one list only, and a seed with one neighbour
    only, are met by one path, so such paths' chances are added up at their middle node and no row is made
    for seed and path; where the middle node is its own neighbour there may be two paths. Degrees are
    (node_id, in_degree, out_degree).
    """
    hits = path_hits(edges, deg, train, fanouts, simple).unionAll(train.select("node_id", F.lit(1.0).alias("hit")))
    return hits.groupBy("node_id").agg(F.sum("hit").alias("visits"))


def rank_random(nodes: DataFrame, seed: int) -> DataFrame:
    return rank_by_draw(nodes.select("node_id"), draw(seed, F.col("node_id")), "node_id").select("node_id", "rank")


def build_cache(ranking: DataFrame, num_nodes: int, share: float) -> DataFrame:
    """(node_id, cache_pos): the first int(num_nodes * share) of a ranking, place = slot."""
    return ranking.where(F.col("rank") < int(num_nodes * share)).select("node_id", F.col("rank").alias("cache_pos"))


def select_cache(deg: DataFrame, num_nodes: int, share: float) -> DataFrame:
    """build_cache(rank_degree(deg), ...) without ranking the nodes that stay outside: those inside are selected first."""
    own = first_k(deg.select("node_id", "out_degree"), int(num_nodes * share), "out_degree", "node_id", descending=True)
    return rank_by_value(own, "out_degree", "node_id", "cache_pos").select("node_id", "cache_pos")


def replace_cache(nodes: DataFrame, batch_nodes: DataFrame) -> DataFrame:
    """A new cache of exactly these nodes, slots by id; with a batch_key, one for each batch, ranked by itself."""
    if "batch_key" in batch_nodes.columns:
        ids = batch_nodes.select("batch_key", "node_id").distinct()
        place = F.row_number().over(Window.partitionBy("batch_key").orderBy("node_id")).cast("long") - 1
        return ids.withColumn("cache_pos", place).join(nodes, "node_id")
    ids = batch_nodes.select("node_id").distinct()
    ranked = global_rank(ids, [F.col("node_id")], "cache_pos")
    return ranked.join(nodes, "node_id")
