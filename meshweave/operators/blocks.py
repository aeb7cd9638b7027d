"""Multi-layer sampling and relabelling of each batch's nodes to dense local ids."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialise
from .sampling import neighbours


@dataclasses.dataclass(frozen=True)
class SampleResult:
    """blocks(batch_key, layer, row, col[, w]), id_map(batch_key, node_id, local_id, reached)."""

    edges: DataFrame
    id_map: DataFrame
    blocks: DataFrame

    def inputs(self) -> DataFrame:
        return self.id_map.select("batch_key", "node_id", "local_id")

    def outputs(self) -> DataFrame:
        return self.id_map.where("reached = 0").select("batch_key", "node_id", "local_id")

    def ahead(self, edges: DataFrame, hops: int) -> DataFrame:
        """(batch_key, node_id): of what each batch loads ahead by its nodes before the last hop, those that the next batch reads."""
        needed = self.inputs().select((F.col("batch_key") - 1).alias("batch_key"), "node_id")
        return prefetch_set(edges, self.id_map.where(F.col("reached") < hops), needed)

    def sizes(self) -> DataFrame:
        """(batch_key, layer, num_edge, num_dst, num_src): a layer's edges, the nodes it was sampled for and all nodes known after it."""
        edges = self.blocks.groupBy("batch_key", "layer").agg(F.count("*").alias("num_edge"))
        met = self.id_map.groupBy("batch_key", "reached").agg(F.count("*").alias("n"))
        both = edges.join(met, "batch_key").where(F.col("reached") <= F.col("layer") + 1)
        before = F.when(F.col("reached") <= F.col("layer"), F.col("n")).otherwise(F.lit(0).cast("long"))
        return both.groupBy("batch_key", "layer", "num_edge").agg(F.sum(before).alias("num_dst"), F.sum("n").alias("num_src"))


def sample_layers(frontier: DataFrame, hops: list[Callable[[DataFrame, int], DataFrame]], write_layers: bool = True) -> tuple[DataFrame, DataFrame]:
    """(layer_edges, reached): each hop samples for all nodes known so far, layer 0 being nearest the seeds.

    frontier is (batch_key, node_id, pos). A hop maps (frontier, layer) to (batch_key, dst, src[, w]).
    reached has for each node the layer that first met it and its place among the seeds.
    A layer's edges are read by the next hop, the relabelling and the result, and the nodes known by
    each of them too. write_layers writes both once to the shared folder, which keeps plans from
    doubling with each layer and lets the next hop's join go by the true size of its frontier.
    """
    keep = materialise if write_layers else lambda df, tag: df
    known = frontier.select("batch_key", "node_id", F.lit(0).alias("reached"), F.col("pos").cast("long").alias("pos"))
    known, found = keep(known, "known"), None
    for layer, hop in enumerate(hops):
        edges = hop(known.select("batch_key", "node_id"), layer).withColumn("layer", F.lit(layer))
        edges = keep(edges, "layer")
        found = edges if found is None else found.unionByName(edges)
        more = edges.select("batch_key", F.col("src").alias("node_id"), F.lit(layer + 1).alias("reached"), F.lit(None).cast("long").alias("pos"))
        known = keep(known.unionAll(more).groupBy("batch_key", "node_id").agg(F.min("reached").alias("reached"), F.min("pos").alias("pos")), "known")
    return found, known


def relabel(reached: DataFrame) -> DataFrame:
    """id_map(batch_key, node_id, local_id, reached): seeds by place, then each layer's new nodes by id.

    Ids of a layer extend those of the layer before, so a prefix of the ids is a layer's destinations.
    """
    order = Window.partitionBy("batch_key").orderBy("reached", F.col("pos").asc_nulls_last(), "node_id")
    return reached.select("batch_key", "node_id", (F.row_number().over(order).cast("long") - 1).alias("local_id"), "reached")


def to_blocks(layer_edges: DataFrame, id_map: DataFrame) -> DataFrame:
    """Both ends by local id: row is the neighbour, col the node sampled for."""
    a = id_map.select("batch_key", F.col("node_id").alias("src"), F.col("local_id").alias("row"))
    b = id_map.select("batch_key", F.col("node_id").alias("dst"), F.col("local_id").alias("col"))
    more = [c for c in layer_edges.columns if c not in ("batch_key", "dst", "src", "layer")]
    return layer_edges.join(a, ["batch_key", "src"]).join(b, ["batch_key", "dst"]).select("batch_key", "layer", "row", "col", *more)


def sample_blocks(frontier: DataFrame, hops: list[Callable[[DataFrame, int], DataFrame]], write_layers: bool = True) -> SampleResult:
    edges, reached = sample_layers(frontier, hops, write_layers)
    ids = relabel(reached)
    return SampleResult(edges, ids, to_blocks(edges, ids))


def fill_unique(seeds: DataFrame) -> DataFrame:
    """Local id = place in the batch."""
    return seeds.select("batch_key", "node_id", F.col("pos").cast("long").alias("local_id"))


def fill_duplicates(known: DataFrame, arrivals: DataFrame) -> DataFrame:
    """known(batch_key, node_id, local_id) extended by new nodes of arrivals(batch_key, node_id, pos), first met first."""
    new = arrivals.join(known, ["batch_key", "node_id"], "left_anti").groupBy("batch_key", "node_id").agg(F.min("pos").alias("first"))
    size = known.groupBy("batch_key").agg((F.max("local_id") + 1).alias("base"))
    order = Window.partitionBy("batch_key").orderBy("first", "node_id")
    placed = new.withColumn("at", F.row_number().over(order).cast("long") - 1).join(size, "batch_key", "left")
    return known.unionAll(placed.select("batch_key", "node_id", (F.col("at") + F.coalesce("base", F.lit(0))).alias("local_id")))


def fill_neighbours(known: DataFrame, edges: DataFrame) -> DataFrame:
    """known extended by every neighbour of every known node, in id order."""
    near = neighbours(edges, known).select("batch_key", F.col("src").alias("node_id"), F.col("src").alias("pos"))
    return fill_duplicates(known, near)


def to_global(locals_: DataFrame, id_map: DataFrame) -> DataFrame:
    return locals_.join(id_map.select("batch_key", "local_id", "node_id"), ["batch_key", "local_id"])


#: Bits for each pair that is asked for (one in sixteen of the others passes), and bits of one broadcast filter: 64 MB.
PAIR_BITS, FILTER_BITS = 16, 1 << 29


def prefetch_set(edges: DataFrame, reached: DataFrame, needed: DataFrame | None = None) -> DataFrame:
    """All neighbours of a batch's nodes: what a dynamic cache loads ahead.

    A batch loads far more ahead than the next one reads. needed (batch_key, node_id) asks for these pairs only:
    the others are dropped as their list is read, by a broadcast filter of a bit for each pair's hash, and what passes
    meets the pairs themselves. Batches beyond one filter's size take turns.
    """
    if needed is None:
        return neighbours(edges, reached).select("batch_key", F.col("src").alias("node_id")).distinct()
    needed = materialise(needed.select("batch_key", "node_id").distinct(), "needed")
    bits = max(needed.count(), 1) * PAIR_BITS
    turns, found = -(-bits // FILTER_BITS), None
    for turn in range(turns):
        mine = F.pmod(F.col("batch_key"), F.lit(turns)) == turn
        near = neighbours(edges, reached.where(mine)).select("batch_key", F.col("src").alias("node_id"))
        asked = needed.where(mine)
        likely = _among(near, asked, bits // turns)
        part = materialise(asked.join(likely, ["batch_key", "node_id"], "left_semi"), "ahead")
        found = part if found is None else found.unionAll(part)
    return found


def _among(rows: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """rows without most of the pairs that are not among wanted's, and with all that are."""
    at = F.pmod(F.xxhash64("batch_key", "node_id"), F.lit(bits))
    bucket, place = F.floor(at / 64).cast("long"), F.pmod(at, F.lit(64)).cast("int")
    row, word = F.floor(bucket / 512).cast("long"), F.pmod(bucket, F.lit(512)).cast("int")
    words = wanted.select(bucket.alias("__w"), F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("__b")).groupBy("__w").agg(F.bit_or("__b").alias("__b"))
    packed = words.groupBy(F.floor(F.col("__w") / 512).cast("long").alias("__row")).agg(F.map_from_entries(F.collect_list(F.struct(F.pmod("__w", F.lit(512)).cast("int"), "__b"))).alias("__m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.coalesce(F.col("__m")[i], F.lit(0).cast("long")))
    filters = materialise(packed.select("__row", every.alias("__words")), "filter")
    met = rows.withColumns({"__row": row, "__word": word, "__place": place}).join(F.broadcast(filters), "__row")
    return met.where(F.call_function("bit_get", F.col("__words")[F.col("__word")], F.col("__place")) == 1).select(*rows.columns)
