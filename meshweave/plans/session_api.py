"""The engine as an object: configuration, batches, sampled blocks, features, caches and reports.

Placement settings of GPU engines (devices, worker and copy limits) have no meaning on a cluster,
where Spark places work; they are accepted by name and ignored, so old settings load unchanged.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import access, batching, blocks, build, cache, gather, sampling, weights
from ..sources.market import Graph
from .run_log import RunLog
from .storage import materialise

#: Names that existing settings use.
SAMPLE_TYPES = ("khop0", "khop1", "khop2", "random_walk", "weighted_khop", "weighted_khop_prefix", "weighted_khop_hash_dedup")
CACHE_POLICIES = ("degree", "heuristic", "pre_sample", "degree_hop", "presample_static", "fake_optimal", "dynamic_cache", "random")
PLACEMENTS = ("arch0", "arch1", "arch2", "arch3", "arch4", "arch5", "arch6", "arch7")


@dataclasses.dataclass(frozen=True)
class SamplerConfig:
    sample_type: str = "khop2"
    batch_size: int = 8000
    num_epoch: int = 1
    fanout: tuple[int, ...] = (25, 10)
    cache_policy: str = "degree"
    cache_percentage: float = 0.0
    presample_epoch: int = 1
    random_walk_length: int = 3
    random_walk_restart_prob: float = 0.5
    num_random_walk: int = 4
    weight_policy: str = "source_suffix"
    seed: int = 0

    def __post_init__(self):
        for value, known in ((self.sample_type, SAMPLE_TYPES), (self.cache_policy, CACHE_POLICIES)):
            if value not in known:
                raise ValueError(f"{value} is none of {', '.join(known)}")
        if self.batch_size < 1 or self.num_epoch < 1 or not self.fanout or min(self.fanout) < 1:
            raise ValueError("batch_size, num_epoch and fanouts are at least 1")
        if not 0 <= self.cache_percentage <= 1 or not 0 <= self.random_walk_restart_prob <= 1:
            raise ValueError("cache_percentage and random_walk_restart_prob lie in 0..1")

    @classmethod
    def from_settings(cls, settings: Mapping[str, object]) -> SamplerConfig:
        """From a mapping of strings or values; keys may have a leading underscore, unknown ones are ignored."""
        plain = {k.lstrip("_"): v for k, v in settings.items()}
        for key in ("sample_type", "batch_size", "num_epoch"):
            if key not in plain:
                raise ValueError(f"settings lack {key}")
        if plain["sample_type"] == "random_walk":
            for key in ("random_walk_length", "random_walk_restart_prob", "num_random_walk", "num_neighbor", "num_layer"):
                if key not in plain:
                    raise ValueError(f"random walks need {key}")
            plain["fanout"] = [int(plain["num_neighbor"])] * int(plain["num_layer"])
        elif "fanout" not in plain:
            raise ValueError("settings lack fanout")
        if isinstance(plain["fanout"], str):
            plain["fanout"] = plain["fanout"].split()
        plain["fanout"] = tuple(int(x) for x in plain["fanout"])
        kinds = {f.name: type(f.default) for f in dataclasses.fields(cls)}
        return cls(**{k: kinds[k](v) for k, v in plain.items() if k in kinds})


class Sampler(RunLog):
    """One graph under one configuration, with the log of its run. DataFrames hold all batches at once, told apart by batch_key."""

    def __init__(self, graph: Graph, config: SamplerConfig):
        self.graph, self.config = graph, config

    @cached_property
    def train_set(self) -> DataFrame:
        return self.graph.splits.where("split = 'train'").select("node_id")

    @cached_property
    def degrees(self) -> DataFrame:
        return self.graph.degrees if self.graph.degrees is not None else build.degrees(self.graph.nodes, self.graph.edges)

    @cached_property
    def hubs(self) -> bool:
        """Whether some list is too long for one task; scans of lists then go range by range."""
        return self.graph.hubs or self.degrees.where(F.col("in_degree") > build.HUB_EDGES).limit(1).count() > 0

    @cached_property
    def lists(self) -> DataFrame:
        """The graph's lists with places, written once where the graph does not bring them."""
        return self.graph.lists if self.graph.lists is not None else materialise(build.with_positions(self.graph.edges, self.hubs), "lists")

    def num_epoch(self) -> int:
        return self.config.num_epoch

    @cached_property
    def steps_per_epoch(self) -> int:
        return batching.num_steps(self.train_set.count(), self.config.batch_size)

    def num_class(self) -> int:
        return self.graph.nodes.agg(F.max("label")).first()[0] + 1

    def feat_dim(self) -> int:
        return self.graph.nodes.select(F.size("feat")).first()[0]

    def batches(self, epochs: int | None = None) -> DataFrame:
        return batching.make_batches(self.train_set, epochs or self.config.num_epoch, self.config.batch_size, self.config.seed)

    @cached_property
    def _adjacency(self) -> DataFrame:
        """What the sample type reads of each list, written once for all layers."""
        kind, edges = self.config.sample_type, self.graph.edges
        if kind in ("khop0", "khop1", "khop2", "random_walk"):
            return self.lists
        weighted = weights.edge_weights(edges, self.degrees, self.config.weight_policy, self.config.seed)
        if kind == "weighted_khop":
            return materialise(weights.alias_table(weights.prefix_table(weighted, self.hubs), self.hubs), "alias")
        return materialise(weights.prefix_table(weighted, self.hubs) if kind == "weighted_khop_prefix" else weighted, "weights")

    def _hop(self, frontier: DataFrame, layer: int) -> DataFrame:
        c, adj = self.config, self._adjacency
        fanout = c.fanout[len(c.fanout) - 1 - layer]
        if c.sample_type == "random_walk":
            return sampling.visit_topk(sampling.random_walk(adj, frontier, c.random_walk_length, c.random_walk_restart_prob, c.num_random_walk, c.seed + layer), fanout)
        if c.sample_type in ("khop0", "khop1", "khop2"):
            draw = sampling.khop_replace if c.sample_type == "khop1" else sampling.khop_places
            return draw(adj, frontier, fanout, c.seed, layer, self.degrees)
        if c.sample_type == "weighted_khop_prefix":
            return sampling.khop_prefix(adj, frontier, fanout, c.seed, layer, self.hubs)
        draw = sampling.khop_alias if c.sample_type == "weighted_khop" else sampling.khop_weighted
        return draw(adj, frontier, fanout, c.seed, layer)

    def sample(self, batches: DataFrame | None = None) -> blocks.SampleResult:
        """Blocks of all layers, the last fanout nearest the seeds."""
        b = self.batches() if batches is None else batches
        return blocks.sample_blocks(b.select("batch_key", "node_id", "pos"), [self._hop] * len(self.config.fanout))

    def all_neighbours(self, batches: DataFrame | None = None) -> DataFrame:
        b = self.batches() if batches is None else batches
        return sampling.all_neighbour_frontier(self.graph.edges, b, len(self.config.fanout))

    def features(self, result: blocks.SampleResult) -> DataFrame:
        return gather.gather(self.graph.nodes, result.inputs(), "feat")

    def labels(self, result: blocks.SampleResult) -> DataFrame:
        return gather.labels(self.graph.nodes, result.outputs())

    def load_subtensor(self, result: blocks.SampleResult) -> tuple[DataFrame, DataFrame]:
        return self.features(result), self.labels(result)

    def ranking(self) -> DataFrame:
        """(node_id, rank) under the configured policy."""
        c, g = self.config, self.graph
        if c.cache_policy == "degree":
            return cache.rank_degree(self.degrees)
        if c.cache_policy == "heuristic":
            return cache.rank_heuristic(g.nodes, g.edges, self.train_set, self.degrees)
        if c.cache_policy == "degree_hop":
            return cache.rank_degree_hop(g.nodes, g.edges, self.train_set, self.degrees)
        if c.cache_policy == "pre_sample":
            return cache.rank_presample(g.nodes, self.sample(self.batches(c.presample_epoch)).inputs())
        if c.cache_policy == "presample_static":
            return cache.rank_presample(g.nodes, self.all_neighbours(self.batches(c.presample_epoch)))
        if c.cache_policy == "fake_optimal":
            from ..functions.ranks import global_rank

            visits = cache.expected_visits(g.edges, self.degrees, self.train_set, simple=g.simple)
            rows = g.nodes.select("node_id").join(visits, "node_id", "left").withColumn("v", F.round(F.coalesce("visits", F.lit(0.0)), 9))
            return global_rank(rows, [F.col("v").desc(), F.col("node_id").desc()]).select("node_id", "rank")
        if c.cache_policy == "random":
            return cache.rank_random(g.nodes, c.seed)
        raise ValueError("a dynamic cache has no ranking: see dynamic_hits")

    @cached_property
    def _cached(self) -> DataFrame:
        share = self.config.cache_percentage
        if self.config.cache_policy == "degree":
            rows = cache.select_cache(self.degrees, self.graph.num_nodes, share)
        else:
            rows = cache.build_cache(self.ranking(), self.graph.num_nodes, share)
        return materialise(rows, "cached")

    def cached(self) -> DataFrame:
        """(node_id, cache_pos) under the configured policy, ranked once and written."""
        return self._cached

    def cached_features(self, result: blocks.SampleResult) -> DataFrame:
        rows = int(self.graph.num_nodes * self.config.cache_percentage)
        store = self.cached().join(self.graph.nodes.select("node_id", "feat"), "node_id")
        return gather.cached_gather(self.graph.nodes, store, result.inputs(), "feat", cached_rows=rows)

    def hit_rate(self, result: blocks.SampleResult) -> DataFrame:
        if self.config.cache_policy == "dynamic_cache":
            near = result.ahead(self.graph.edges, len(self.config.fanout))
            return gather.dynamic_hits(result.inputs(), near)
        return gather.hit_rate(gather.cache_split(result.inputs(), self.cached(), int(self.graph.num_nodes * self.config.cache_percentage)))

    def dynamic_features(self, result: blocks.SampleResult) -> DataFrame:
        """Inputs' features with is_hit under a dynamic cache: what the batch before prefetched is a hit."""
        near = result.ahead(self.graph.edges, len(self.config.fanout))
        return gather.dynamic_gather(self.graph.nodes, result.inputs(), near, "feat")

    def log_sizes(self, result: blocks.SampleResult) -> None:
        """Log each batch's sampled edges, nodes and nodes of the last layer: one row a block comes to the driver."""
        for r in result.sizes().collect():
            epoch, step = divmod(r["batch_key"], self.steps_per_epoch)
            self.log_step_add(epoch, step, "num_sample", r["num_edge"])
            self.log_step(epoch, step, "num_node", max(r["num_src"], self.get_log_step_value(epoch, step, "num_node")))
            if r["layer"] == len(self.config.fanout) - 1:
                self.log_step(epoch, step, "last_layer_size", r["num_src"])

    def block_sizes(self, result: blocks.SampleResult) -> DataFrame:
        """(batch_key, layer, num_edge, num_dst, num_src) of each block."""
        return result.sizes()

    def access_log(self, result: blocks.SampleResult) -> DataFrame:
        """access(batch_key, epoch, step, node_id) of the batches' inputs."""
        steps = self.steps_per_epoch
        return result.inputs().select("batch_key", F.floor(F.col("batch_key") / steps).cast("long").alias("epoch"), (F.col("batch_key") % steps).alias("step"), "node_id")

    def report_node_access(self, result: blocks.SampleResult) -> DataFrame:
        return access.access_report(self.access_log(result), self.degrees)
