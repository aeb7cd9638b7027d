"""Graph construction: symmetrising, positions, offsets, compaction, degrees, splits, subgraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import draw
from ..functions.ranks import global_rank, rank_by_draw, running_sums
from ..functions.selection import first_k


def symmetrise(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; duplicates stay."""
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def with_positions(edges: DataFrame, hubs: bool = False) -> DataFrame:
    """adj(dst, pos, src, deg): place of each in-neighbour in its list, sorted by src; duplicates kept.

    A list is sorted in one task; hubs is for graphs with lists too long for that, which are then
    placed range by range.
    """
    if hubs:
        placed = running_sums(edges.select("dst", "src"), "dst", [F.col("src").asc()], {"deg": "pos"}, pos=F.lit(1).cast("long"))
        return placed.select("dst", (F.col("pos") - 1).alias("pos"), "src", "deg")
    w = Window.partitionBy("dst")
    return edges.select("dst", (F.row_number().over(w.orderBy("src")).cast("long") - 1).alias("pos"), "src", F.count("*").over(w).alias("deg"))


def edge_places(adj: DataFrame) -> DataFrame:
    """(at, dst, pos, src): each edge's place in the order of (dst, pos), from 0."""
    counts = adj.where("pos = 0").select("dst", "deg")
    at = offsets(counts, "dst", "deg")
    return adj.join(at, "dst").select((F.col("offset") + F.col("pos")).alias("at"), "dst", "pos", "src")


def collapse(edges: DataFrame) -> DataFrame:
    """Multi-edges as one."""
    return edges.select("src", "dst").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """degrees(node_id, in_degree, out_degree) of every node: list length and occurrences in lists."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    counted = ends.groupBy("e.node_id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    zero = F.lit(0).cast("long")
    return nodes.select("node_id").join(counted, "node_id", "left").select("node_id", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))


def offsets(counts: DataFrame, key: str = "node_id", size: str = "in_degree", width: int = 65536) -> DataFrame:
    """(key, offset): exclusive running sum of size by key; only sums of key ranges meet in one task."""
    tagged = counts.withColumn("__k", F.floor(F.col(key) / width))
    sums = tagged.groupBy("__k").agg(F.sum(size).alias("__n"))
    before = Window.orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("__k", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__k").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = tagged.withColumn("__in", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(base, "__k")
    return rows.select(key, (F.col("__in") + F.col("__base")).cast("long").alias("offset"))


def id_dictionary(ids: DataFrame) -> DataFrame:
    """(old_id, new_id): dense ids in the order of the old ones."""
    return global_rank(ids.distinct(), [F.col("old_id")], "new_id").select("old_id", "new_id")


def remap(edges: DataFrame, dictionary: DataFrame) -> DataFrame:
    a = dictionary.select(F.col("old_id").alias("src"), F.col("new_id").alias("s"))
    b = dictionary.select(F.col("old_id").alias("dst"), F.col("new_id").alias("d"))
    return edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def random_splits(deg: DataFrame, sizes: dict[str, int], seed: int) -> DataFrame:
    """(node_id, split, pos): disjoint random sets of nodes with neighbours, in the order of sizes.

    Nodes of the lowest digests are selected first (by 60 bits, ties by id), so only those are ranked.
    """
    order = draw(seed, F.col("node_id"))
    near = deg.where("in_degree > 0").select("node_id", F.conv(F.substring(order, 1, 15), 16, 10).cast("long").alias("__v"))
    ranked = rank_by_draw(first_k(near, sum(sizes.values()), "__v", "node_id").select("node_id"), order, "node_id")
    split, pos, start = F.lit(None).cast("string"), F.lit(None).cast("long"), 0
    for name, n in sizes.items():
        inside = (F.col("rank") >= start) & (F.col("rank") < start + n)
        split, pos, start = F.when(inside, name).otherwise(split), F.when(inside, F.col("rank") - start).otherwise(pos), start + n
    return ranked.where(F.col("rank") < start).select("node_id", split.alias("split"), pos.alias("pos"))


def splits_by_type(nodes: DataFrame, kind: Column) -> DataFrame:
    named = F.when(kind == 1, "train").when(kind == 2, "valid").when(kind == 3, "test")
    return nodes.select("node_id", named.alias("split")).where("split is not null")


def induced_rows(edges: DataFrame, touched: DataFrame) -> DataFrame:
    """Lists of touched nodes, whole; all other lists empty."""
    return edges.join(touched.select(F.col("node_id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


#: Neighbours in one row of chunked lists, and the length from which a list is no one task's.
CHUNK, HUB_EDGES = 65_536, 1_000_000


def chunked_lists(adj: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(dst, chunk, neighbours) of adj(dst, pos, src): lists in order, in rows of at most `chunk` neighbours each."""
    part = F.floor(F.col("pos") / chunk).cast("long")
    rows = adj.groupBy("dst", part.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("pos", "src"))).alias("l"))
    return rows.select("dst", "chunk", F.col("l.src").alias("neighbours"))


def adjacency_lists(edges: DataFrame, by: str = "dst", of: str = "src") -> DataFrame:
    """A row a list, whole: for graphs whose longest list is known to fit a row; see chunked_lists."""
    return edges.groupBy(by).agg(F.array_sort(F.collect_list(of)).alias("neighbours"))
