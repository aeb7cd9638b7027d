"""Queries over samplers, blocks, relabelling, gathers, caches, batches and layers of the market graph."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.rand import draw
from ..operators import batching, blocks, build, cache, gather, layers, reach, sampling, training, weights
from ..sources import market, records
from ..streaming import prefetch
from . import sql_surface
from .declare import query
from .sql import BATCH, EPOCHS, SEED, khop, khop_digest, layered, md5, u32, uniform, with_
from .storage import shared_root

TWO = layered("frontier", [10, 5])
WALKS, STEPS, RESTART, TOP = 4, 3, 0.5, 5


def batches(spark, sf_dir):
    g = market.market(spark, sf_dir)
    return g, batching.make_batches(market.train_set(g), EPOCHS, BATCH, SEED)


def frontier(spark, sf_dir):
    g, b = batches(spark, sf_dir)
    return g, b.where("epoch = 0").select("batch_key", "node_id", "pos")


def two_layers(spark, sf_dir, every_epoch: bool = False):
    g, b = batches(spark, sf_dir)
    seeds = (b if every_epoch else b.where("epoch = 0")).select("batch_key", "node_id", "pos")
    hops = [lambda f, layer, n=n: sampling.khop_places(g.lists, f, n, SEED, layer, g.degrees) for n in (10, 5)]
    return g, b, blocks.sample_blocks(seeds, hops)


def _degrees(g):
    return g.degrees if g.degrees is not None else build.degrees(g.nodes, g.edges)


@query(with_(["batches"], "SELECT batch_key, epoch, step, pos, node_id FROM batches"))
def j1_epoch_batches(spark, sf_dir):
    return batches(spark, sf_dir)[1]


@query(with_(["batches", "steps"], f"SELECT batch_key, step % 3 trainer, least(step // greatest(1, st // 3), 2) sampler, count(*) num_node FROM batches, steps GROUP BY ALL"))
def j5_workers(spark, sf_dir):
    g, b = batches(spark, sf_dir)
    steps = batching.num_steps(market.train_set(g).count(), BATCH)
    return b.groupBy("batch_key", batching.aligned_worker(F.col("step"), 3).alias("trainer"), batching.sampler_worker(F.col("step"), steps, 3).alias("sampler")).agg(F.count("*").alias("num_node"))


@query(with_(["edges", "frontier"], "SELECT batch_key, dst, src FROM s", s=khop_digest("frontier", 10, 0)))
def c1_khop_uniform(spark, sf_dir):
    g, f = frontier(spark, sf_dir)
    return sampling.khop(g.edges, f, 10, SEED, simple=g.simple)


#: Parts and suppliers with one edge for each line item: many edges are there several times.
MULTI = {
    "multi": "SELECT CAST(l_suppkey AS BIGINT) src, CAST(l_partkey AS BIGINT) dst FROM lineitem",
    "places": "SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 pos, count(*) OVER (PARTITION BY dst) deg FROM multi",
    "asked": "SELECT CAST(p_partkey % 7 AS BIGINT) batch_key, CAST(p_partkey AS BIGINT) node_id FROM part",
}


def _multigraph(spark, sf_dir):
    edges = market.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("src"), F.col("l_partkey").cast("long").alias("dst"))
    part = F.col("p_partkey").cast("long")
    return edges, market.read(spark, sf_dir, "part").select((part % 7).alias("batch_key"), part.alias("node_id"))


COPY_KEY = f"CASE WHEN copy > 0 THEN {md5(SEED, 'batch_key', 0, 'dst', 'src', 'copy')} ELSE {md5(SEED, 'batch_key', 0, 'dst', 'src')} END"


@query(f"WITH {', '.join(f'{k} AS ({v})' for k, v in MULTI.items())}, met AS (SELECT batch_key, dst, src, row_number() OVER (PARTITION BY batch_key, dst, src) - 1 copy FROM multi JOIN asked ON dst = node_id) SELECT batch_key, dst, src FROM (SELECT *, row_number() OVER (PARTITION BY batch_key, dst ORDER BY {COPY_KEY}, src) rn FROM met) WHERE rn <= 8")
def c1_multigraph(spark, sf_dir):
    """Copies of an edge are drawn each by itself, without replacement."""
    edges, asked = _multigraph(spark, sf_dir)
    return sampling.khop(edges, asked, 8, SEED)


@query(f"WITH {', '.join(f'{k} AS MATERIALIZED ({v})' for k, v in MULTI.items())} {khop('asked', 8, 0, 'places')}")
def c3_multigraph_places(spark, sf_dir):
    """The same law by as many draws as neighbours wanted, whatever the degree."""
    edges, asked = _multigraph(spark, sf_dir)
    return sampling.khop_places(build.with_positions(edges), asked, 8, SEED)


@query(with_(["adj", "frontier"], f"SELECT DISTINCT d.batch_key, d.dst, a.src FROM (SELECT f.batch_key, g.dst, {u32(SEED, 'f.batch_key', 0, 'g.dst', 't')} % g.deg pos FROM frontier f JOIN adj g ON g.dst = f.node_id AND g.pos = 0, (SELECT unnest(range(10)) t)) d JOIN adj a ON a.dst = d.dst AND a.pos = d.pos"))
def c2_khop_replace(spark, sf_dir):
    g, f = frontier(spark, sf_dir)
    return sampling.khop_replace(g.lists, f, 10, SEED, degrees=g.degrees)


@query(with_(["edges", "frontier"], "SELECT batch_key, dst, src FROM s", s=khop("frontier", 25, 3)))
def c3_khop_fisher(spark, sf_dir):
    """Positions without replacement, as many draws as neighbours wanted: the law of a partial Fisher-Yates shuffle."""
    g, f = frontier(spark, sf_dir)
    return sampling.khop_places(g.lists, f, 25, SEED, 3, g.degrees)


def _alias(g):
    weighted = weights.edge_weights(g.edges, _degrees(g), "source_suffix")
    return weights.alias_table(weights.prefix_table(weighted, g.hubs), g.hubs)


#: Alias tables from running sums: light slots take the first heavy one past their need, spent heavy ones the next.
ALIAS = {
    "spare": "SELECT dst, pos, src, w, deg, w * deg - sum(w) OVER o s, sum(w) OVER o total FROM prefixes WINDOW o AS (PARTITION BY dst ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "poor": "SELECT dst, pos, s, total, sum(-s) OVER (PARTITION BY dst ORDER BY pos) need, coalesce(sum(-s) OVER (PARTITION BY dst ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given FROM spare WHERE s < 0",
    "rich": "SELECT dst, pos, src, total, sum(s) OVER (PARTITION BY dst ORDER BY pos) give, lead(src) OVER (PARTITION BY dst ORDER BY pos) nxt FROM spare WHERE s >= 0",
    "filled": "SELECT p.dst, p.pos, (p.s + p.total) / p.total prob, r.src alias FROM poor p ASOF JOIN rich r ON p.dst = r.dst AND p.given < r.give",
    "spent": "SELECT r.dst, r.pos, 1 + (r.give - p.need) / r.total prob, r.nxt alias FROM rich r ASOF JOIN poor p ON p.dst = r.dst AND r.give <= p.need WHERE p.need > r.give AND r.nxt IS NOT NULL",
    "alias": "SELECT x.dst, x.pos, x.src, x.deg, coalesce(y.prob, 1) prob, coalesce(y.alias, x.src) alias FROM spare x LEFT JOIN (SELECT * FROM filled UNION ALL SELECT * FROM spent) y USING (dst, pos)",
}
ALIAS_DRAWS = f"""SELECT f.batch_key, g.dst, {u32(SEED, chr(39) + 'slot' + chr(39), 'f.batch_key', 0, 'g.dst', 't')} % g.deg pos, {uniform(SEED, chr(39) + 'keep' + chr(39), 'f.batch_key', 0, 'g.dst', 't')} u
 FROM frontier f JOIN alias g ON g.dst = f.node_id AND g.pos = 0, (SELECT unnest(range(10)) t)"""


@query(with_(["prefixes", "frontier"], "SELECT DISTINCT d.batch_key, d.dst, CASE WHEN d.u < a.prob THEN a.src ELSE a.alias END src FROM draws d JOIN alias a USING (dst, pos)", **ALIAS, draws=ALIAS_DRAWS))
def c4_khop_alias(spark, sf_dir):
    g, f = frontier(spark, sf_dir)
    return sampling.khop_alias(_alias(g), f, 10, SEED)


@query(with_(["prefixes", "frontier"], """SELECT DISTINCT d.batch_key, d.dst, p.src FROM (SELECT f.batch_key, l.dst, """ + uniform(SEED, "f.batch_key", 0, "l.dst", "t") + """ * l.top x FROM frontier f JOIN (SELECT dst, max(prefix) top FROM prefixes GROUP BY 1) l ON l.dst = f.node_id, (SELECT unnest(range(10)) t)) d
 JOIN prefixes p ON p.dst = d.dst AND p.prefix >= d.x AND p.prefix - p.w < d.x"""))
def c5_khop_prefix(spark, sf_dir):
    g, f = frontier(spark, sf_dir)
    table = weights.prefix_table(weights.edge_weights(g.edges, _degrees(g), "source_suffix"), g.hubs)
    return sampling.khop_prefix(table, f, 10, SEED, hubs=g.hubs)


@query(with_(["inverse", "frontier"], "SELECT batch_key, dst, src FROM s", s=khop_digest("frontier", 10, 0, "inverse", f"-ln({uniform(SEED, 'f.batch_key', 0, 'e.dst', 'e.src')}) / e.w")))
def c6_khop_weighted(spark, sf_dir):
    g, f = frontier(spark, sf_dir)
    return sampling.khop_weighted(weights.edge_weights(g.edges, _degrees(g), "inverse_source_degree"), f, 10, SEED, simple=g.simple)


def _walk_sql(frontier: str = "frontier", seed: int = SEED, p: str = "", top: str = "top") -> dict[str, str]:
    out, now = {f"{p}n0": f"SELECT batch_key, node_id seed_id, walk, node_id at_ FROM {frontier}, (SELECT unnest(range({WALKS})) walk)"}, f"{p}n0"
    for s in range(STEPS):
        keys = ("n.batch_key", "n.seed_id", "n.walk", s)
        out[f"{p}v{s}"] = f"SELECT n.batch_key, n.seed_id, n.walk, {s} step, a.src node_id FROM {now} n JOIN adj g ON g.dst = n.at_ AND g.pos = 0 JOIN adj a ON a.dst = n.at_ AND a.pos = {u32(seed, chr(39) + 'step' + chr(39), *keys)} % g.deg"
        out[f"{p}n{s + 1}"] = f"SELECT batch_key, seed_id, walk, node_id at_ FROM {p}v{s} n WHERE {uniform(seed, chr(39) + 'stop' + chr(39), *keys)} >= {RESTART}"
        now = f"{p}n{s + 1}"
    out[f"{p}visits"] = " UNION ALL ".join(f"SELECT * FROM {p}v{s}" for s in range(STEPS))
    out[top] = f"SELECT batch_key, seed_id dst, node_id src, w FROM (SELECT *, row_number() OVER (PARTITION BY batch_key, seed_id ORDER BY w DESC, node_id) rn FROM (SELECT batch_key, seed_id, node_id, count(*) w FROM {p}visits GROUP BY 1, 2, 3)) WHERE rn <= {TOP}"
    return out


WALK = _walk_sql()


def _visits(spark, sf_dir):
    g, f = frontier(spark, sf_dir)
    return g, f, sampling.random_walk(g.lists, f, STEPS, RESTART, WALKS, SEED)


@query(with_(["adj", "frontier"], "SELECT batch_key, seed_id, walk, step, node_id FROM visits", **WALK).replace(" AS (", " AS MATERIALIZED ("))
def c7_random_walk(spark, sf_dir):
    return _visits(spark, sf_dir)[2]


@query(with_(["adj", "frontier"], "SELECT batch_key, dst, src, w FROM top", **WALK))
def c8_visit_topk(spark, sf_dir):
    return sampling.visit_topk(_visits(spark, sf_dir)[2], TOP)


def _walk_blocks_sql() -> dict[str, str]:
    plain = layered("frontier", [1, 1])  # its relabelling over other layers
    return {"k0": plain["k0"], **_walk_sql("k0", SEED, "a", "l0"), "k1": plain["k1"], **_walk_sql("k1", SEED + 1, "b", "l1"), "k2": plain["k2"], "ids": plain["ids"]}


@query(with_(["adj", "frontier"], "SELECT e.batch_key, e.layer, a.local_id AS row, b.local_id AS col, e.w FROM (SELECT *, 0 layer FROM l0 UNION ALL SELECT *, 1 FROM l1) e JOIN ids a ON a.batch_key = e.batch_key AND a.node_id = e.src JOIN ids b ON b.batch_key = e.batch_key AND b.node_id = e.dst", **_walk_blocks_sql()))
def c20_walk_blocks(spark, sf_dir):
    """Two layers of random-walk neighbours with their visit counts, relabelled."""
    g, f = frontier(spark, sf_dir)
    hop = lambda x, layer: sampling.visit_topk(sampling.random_walk(g.lists, x, STEPS, RESTART, WALKS, SEED + layer), TOP)
    return blocks.sample_blocks(f, [hop, hop]).blocks


#: A sum over all components that tells their places apart.
MOMENT = "round(list_sum(list_transform(feat, lambda x, i: CAST(x AS DOUBLE) * i)), 6)"


def _moment(feat: str):
    return F.round(F.aggregate(F.transform(feat, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6)


@query(with_(["edges", "frontier", "nodes"], f"SELECT batch_key, local_id, node_id, round(CAST(feat[64] AS DOUBLE), 6) f_last, {MOMENT} f_moment, CASE WHEN reached = 0 THEN label END AS label FROM ids JOIN nodes USING (node_id)", **TWO))
def e4_features_and_labels(spark, sf_dir):
    """A batch's inputs with features, and labels where they are outputs."""
    g, _, r = two_layers(spark, sf_dir)
    got = gather.gather(g.nodes, r.id_map, "feat", "label")
    return got.select("batch_key", "local_id", "node_id", F.round(F.element_at("feat", -1).cast("double"), 6).alias("f_last"), _moment("feat").alias("f_moment"), F.when(F.col("reached") == 0, F.col("label")).alias("label"))


@query(with_(["edges", "frontier"], "SELECT batch_key, dst, src FROM frontier JOIN edges ON dst = node_id"))
def c9_neighbours(spark, sf_dir):
    g, f = frontier(spark, sf_dir)
    return sampling.neighbours(g.edges, f)


@query(with_(["edges", "frontier"], "SELECT batch_key, count(*) num_node, CAST(sum(node_id) AS BIGINT) id_sum FROM h2 GROUP BY 1",
             h1="SELECT batch_key, node_id FROM frontier UNION SELECT batch_key, src FROM frontier JOIN edges ON dst = node_id", h2="SELECT batch_key, node_id FROM h1 UNION SELECT batch_key, src FROM h1 JOIN edges ON dst = node_id"))
def c10_all_neighbour_hops(spark, sf_dir):
    g, f = frontier(spark, sf_dir)
    return reach.last_hop(g.edges, sampling.all_neighbour_frontier(g.edges, f, 1), by_batch=True)


BLOCKS = "SELECT e.batch_key, e.layer, a.local_id AS row, b.local_id AS col FROM (SELECT *, 0 layer FROM l0 UNION ALL SELECT *, 1 FROM l1) e JOIN ids a ON a.batch_key = e.batch_key AND a.node_id = e.src JOIN ids b ON b.batch_key = e.batch_key AND b.node_id = e.dst"


@query(with_(["edges", "frontier"], BLOCKS, **TWO))
def c11_blocks(spark, sf_dir):
    return two_layers(spark, sf_dir)[2].blocks


@query(with_(["edges", "frontier"], "SELECT batch_key, count(*) num_prefetch FROM (SELECT DISTINCT batch_key, src FROM k1 JOIN edges ON dst = node_id) GROUP BY 1", **TWO))
def c12_prefetch(spark, sf_dir):
    g, f = frontier(spark, sf_dir)
    _, reached = blocks.sample_layers(f, [lambda x, layer: sampling.khop_places(g.lists, x, 10, SEED, layer, g.degrees)])
    return blocks.prefetch_set(g.edges, reached).groupBy("batch_key").agg(F.count("*").alias("num_prefetch"))


@query(with_(["suffix"], "SELECT dst, src, round(w / sum(w) OVER (PARTITION BY dst), 6) mass FROM suffix"))
def c13_alias_mass(spark, sf_dir):
    """Each neighbour's chance by the alias tables: its own slot's and what other slots give it."""
    g = market.market(spark, sf_dir)
    t = _alias(g)
    parts = t.select("dst", "deg", F.explode(F.array(F.struct("src", F.col("prob").alias("m")), F.struct(F.col("alias").alias("src"), (F.lit(1.0) - F.col("prob")).alias("m")))).alias("x"))
    return parts.groupBy("dst", "x.src").agg(F.round(F.sum(F.col("x.m") / F.col("deg")), 6).alias("mass"))


@query(with_(["prefixes"], "SELECT dst, pos, src, w, prefix, deg FROM prefixes"))
def c14_prefix_table(spark, sf_dir):
    g = market.market(spark, sf_dir)
    return weights.prefix_table(weights.edge_weights(g.edges, _degrees(g), "source_suffix"), g.hubs)


@query(with_(["edges", "deg"], f"SELECT e.src, e.dst, CAST({u32(5, chr(39) + 'w' + chr(39), 'e.src', 'e.dst')} % 10 + 1 AS DOUBLE) w_default, round(1.0::DOUBLE / ({u32(5, chr(39) + 'w' + chr(39), 'e.src', 'e.dst')} % greatest(a.out_degree, b.in_degree) + 1), 9) w_both FROM edges e JOIN deg a ON a.node_id = e.src JOIN deg b ON b.node_id = e.dst"))
def c15_weight_policies(spark, sf_dir):
    g = market.market(spark, sf_dir)
    deg = _degrees(g)
    both = weights.edge_weights(weights.edge_weights(g.edges, deg, "default", 5).withColumnRenamed("w", "w_default"), deg, "inverse_both_degree_random", 5)
    return both.select("src", "dst", "w_default", F.round("w", 9).alias("w_both"))


@query(with_(["edges", "frontier"], "SELECT batch_key, node_id, local_id, reached FROM ids", **TWO))
def d2_relabel(spark, sf_dir):
    return two_layers(spark, sf_dir)[2].id_map


@query(with_(["frontier"], "SELECT batch_key, node_id, pos local_id FROM frontier"))
def d1_fill_unique(spark, sf_dir):
    return blocks.fill_unique(frontier(spark, sf_dir)[1])


@query(with_(["edges", "frontier"], "SELECT batch_key, node_id, pos local_id FROM frontier UNION ALL SELECT n.batch_key, n.node_id, row_number() OVER (PARTITION BY n.batch_key ORDER BY n.node_id) - 1 + b FROM n JOIN (SELECT batch_key, count(*) b FROM frontier GROUP BY 1) USING (batch_key)",
             n="SELECT DISTINCT f.batch_key, e.src node_id FROM frontier f JOIN edges e ON e.dst = f.node_id WHERE NOT EXISTS (SELECT 1 FROM frontier g WHERE g.batch_key = f.batch_key AND g.node_id = e.src)"))
def d4_fill_neighbours(spark, sf_dir):
    g, f = frontier(spark, sf_dir)
    return blocks.fill_neighbours(blocks.fill_unique(f), g.edges)


@query(with_(["edges", "frontier"], "SELECT batch_key, dst, src FROM l0 UNION ALL SELECT batch_key, dst, src FROM l1", **TWO))
def d7_map_back(spark, sf_dir):
    """Blocks with local ids turned into global ids again."""
    r = two_layers(spark, sf_dir)[2]
    rows = blocks.to_global(r.blocks.withColumnRenamed("row", "local_id"), r.id_map).select("batch_key", F.col("node_id").alias("src"), F.col("col").alias("local_id"))
    return blocks.to_global(rows, r.id_map).select("batch_key", F.col("node_id").alias("dst"), "src")


@query(with_(["edges", "frontier", "nodes"], "SELECT batch_key, local_id, node_id, round(CAST(feat[1] AS DOUBLE), 6) f0, round(list_sum(list_transform(feat, lambda x: CAST(x AS DOUBLE))), 6) f_sum FROM ids JOIN nodes USING (node_id)", **TWO))
def e1_gather_features(spark, sf_dir):
    g, _, r = two_layers(spark, sf_dir)
    got = gather.gather(g.nodes, r.inputs(), "feat")
    return got.select("batch_key", "local_id", "node_id", F.round(F.col("feat")[0].cast("double"), 6).alias("f0"), F.round(F.aggregate("feat", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("f_sum"))


@query(with_(["nodes", "frontier"], "SELECT batch_key, pos, node_id, label FROM frontier JOIN nodes USING (node_id)"))
def e3_gather_labels(spark, sf_dir):
    g, f = frontier(spark, sf_dir)
    return gather.labels(g.nodes, f).select("batch_key", "pos", "node_id", "label")


CACHED = "SELECT node_id, rank cache_pos FROM (SELECT node_id, row_number() OVER (ORDER BY out_degree DESC, node_id DESC) - 1 AS rank FROM deg) WHERE rank < CAST(floor((SELECT p + s + c FROM size) * 0.1) AS BIGINT)"


def _cached(g):
    return cache.select_cache(_degrees(g), g.num_nodes, 0.1), int(g.num_nodes * 0.1)


@query(with_(["edges", "frontier", "deg"], "SELECT batch_key, node_id, cache_pos, cache_pos IS NOT NULL is_hit FROM ids LEFT JOIN cached USING (node_id)", **TWO, cached=CACHED))
def e6_cache_split(spark, sf_dir):
    g, _, r = two_layers(spark, sf_dir)
    c, n = _cached(g)
    return gather.cache_split(r.inputs().select("batch_key", "node_id"), c, n)


@query(with_(["edges", "frontier", "deg", "nodes"], f"SELECT batch_key, node_id, cached.cache_pos IS NOT NULL is_hit, round(CAST(feat[2] AS DOUBLE), 6) f1, {MOMENT} f_moment FROM ids JOIN nodes USING (node_id) LEFT JOIN cached USING (node_id)", **TWO, cached=CACHED))
def e9_cached_gather(spark, sf_dir):
    g, _, r = two_layers(spark, sf_dir)
    c, n = _cached(g)
    got = gather.cached_gather(g.nodes, c.join(g.nodes.select("node_id", "feat"), "node_id"), r.inputs().select("batch_key", "node_id"), "feat", cached_rows=n)
    return got.select("batch_key", "node_id", "is_hit", F.round(F.col("feat")[1].cast("double"), 6).alias("f1"), _moment("feat").alias("f_moment"))


@query(with_(["edges", "frontier", "deg"], "SELECT count(*) num_input, CAST(count(cache_pos) AS BIGINT) num_hit, round(count(cache_pos) / count(*)::DOUBLE, 6) hit_rate FROM ids LEFT JOIN cached USING (node_id)", **TWO, cached=CACHED))
def g18_hit_rate(spark, sf_dir):
    g, _, r = two_layers(spark, sf_dir)
    c, n = _cached(g)
    return gather.hit_rate(gather.cache_split(r.inputs().select("batch_key", "node_id"), c, n))


@query(with_(["edges", "frontier"], "SELECT i.batch_key, count(*) num_input, count(p.node_id) num_hit FROM ids i LEFT JOIN (SELECT DISTINCT batch_key + 1 batch_key, src node_id FROM k1 JOIN edges ON dst = node_id) p ON p.batch_key = i.batch_key AND p.node_id = i.node_id GROUP BY 1", **TWO))
def e10_dynamic_hits(spark, sf_dir):
    g, f = frontier(spark, sf_dir)
    hops = [lambda x, layer, n=n: sampling.khop_places(g.lists, x, n, SEED, layer, g.degrees) for n in (10, 5)]
    r = blocks.sample_blocks(f, hops)
    return gather.dynamic_hits(r.inputs(), r.ahead(g.edges, 2))


@query(with_(["edges", "frontier", "nodes"], f"SELECT i.batch_key, i.node_id, p.node_id IS NOT NULL is_hit, {MOMENT} f_moment FROM ids i JOIN nodes n ON n.node_id = i.node_id LEFT JOIN (SELECT DISTINCT batch_key + 1 batch_key, src node_id FROM k1 JOIN edges ON dst = node_id) p ON p.batch_key = i.batch_key AND p.node_id = i.node_id", **TWO))
def e10_dynamic_gather(spark, sf_dir):
    """Features of a batch's inputs, taken from what the batch before prefetched where that has them."""
    g, f = frontier(spark, sf_dir)
    hops = [lambda x, layer, n=n: sampling.khop_places(g.lists, x, n, SEED, layer, g.degrees) for n in (10, 5)]
    r = blocks.sample_blocks(f, hops)
    got = gather.dynamic_gather(g.nodes, r.inputs(), r.ahead(g.edges, 2), "feat")
    return got.select("batch_key", "node_id", "is_hit", _moment("feat").alias("f_moment"))


@query(with_(["edges", "frontier", "nodes"], f"SELECT i.batch_key, i.node_id, p.node_id IS NOT NULL is_hit, {MOMENT} f_moment FROM ids i JOIN nodes n ON n.node_id = i.node_id LEFT JOIN (SELECT DISTINCT batch_key + 1 batch_key, src node_id FROM k1 JOIN edges ON dst = node_id) p ON p.batch_key = i.batch_key AND p.node_id = i.node_id", **TWO))
def e10_dynamic_stream(spark, sf_dir):
    """The same from a stream of seeds, a minute a batch, sampled as they come: hits are told by timers over state."""
    g, f = frontier(spark, sf_dir)
    folder = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    timed = f.select("batch_key", "node_id", F.col("pos").cast("long").alias("pos"), F.timestamp_seconds((F.col("batch_key") + 1) * 60).alias("ts"))
    timed.repartitionByRange(4, "batch_key").write.parquet(f"{folder}/in")
    last = timed.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    last.select(*(F.lit(None).cast("long").alias(c) for c in ("batch_key", "node_id", "pos")), "ts").write.mode("append").parquet(f"{folder}/in")
    hops = [lambda x, layer, n=n: sampling.khop_places(g.lists, x, n, SEED, layer, g.degrees) for n in (10, 5)]
    seeds = spark.readStream.schema(prefetch.SEEDS).parquet(f"{folder}/in")
    prefetch.sample_stream(seeds, g.edges, hops, f"{folder}/touched", f"{folder}/sampled", expand=False)
    got = prefetch.decide_stream(spark, f"{folder}/touched", g.nodes, f"{folder}/out", f"{folder}/decided", "feat", late="1 day", edges=g.edges)
    return got.select("batch_key", "node_id", "is_hit", _moment("feat").alias("f_moment"))


def _trained(spark, g, result, kind, epochs=2):
    """(records, model): two layers trained on all batches of a result, eight batches a step."""
    folder = f"{shared_root(spark)}/train-{uuid.uuid4().hex}"
    records.write_batches(result, folder, g.nodes)
    kept = records.open_batches(spark, folder)
    width, classes = g.nodes.agg(F.max(F.size("feat")), F.max("label") + 1).first()
    count = result.id_map.agg(F.max("batch_key") + 1).first()[0]
    return kept, training.train(kept, training.Model.start([width, 32, classes], SEED, kind), count, epochs=epochs)


@query()
def l6_training(spark, sf_dir):
    """Each batch's outputs, loss and right answers under two graph convolutions trained on the whole epoch."""
    g, _, r = two_layers(spark, sf_dir)
    kept, model = _trained(spark, g, r, "gcn")
    return training.score(kept, model).select("batch_key", "n", "correct", F.round("loss", 6).alias("loss"))


@query()
def l6_training_walks(spark, sf_dir):
    """The same under two weighted layers over random-walk neighbours and their visit counts."""
    g, f = frontier(spark, sf_dir)
    walks = lambda f, layer: sampling.visit_topk(sampling.random_walk(g.lists, f, STEPS, RESTART, WALKS, SEED + layer), TOP)
    kept, model = _trained(spark, g, blocks.sample_blocks(f, [walks, walks]), "pinsage")
    return training.score(kept, model).select("batch_key", "n", "correct", F.round("loss", 6).alias("loss"))


@query()
def l6_evaluation(spark, sf_dir):
    """Right answers among all nodes of each split under two mean layers trained on the training set; other splits are sampled in batches of their own."""
    g, _, r = two_layers(spark, sf_dir)
    kept, model = _trained(spark, g, r, "sage")
    hops = [lambda f, layer, n=n: sampling.khop_places(g.lists, f, n, SEED, layer, g.degrees) for n in (10, 5)]
    out = training.predict(kept, model).withColumn("split", F.lit("train"))
    for split in ("valid", "test"):
        own = batching.make_batches(g.splits.where(F.col("split") == split).select("node_id"), 1, BATCH, SEED).select("batch_key", "node_id", "pos")
        folder = f"{shared_root(spark)}/evaluate-{uuid.uuid4().hex}"
        records.write_batches(blocks.sample_blocks(own, hops), folder, g.nodes)
        out = out.unionByName(training.predict(records.open_batches(spark, folder), model).withColumn("split", F.lit(split)))
    return training.accuracy(out, model.layers[-1][-1].size, ["split"])


@query(with_(["edges", "frontier"], "SELECT e.batch_key, e.layer, num_edge, (SELECT count(*) FROM ids i WHERE i.batch_key = e.batch_key AND reached <= layer) num_dst, (SELECT count(*) FROM ids i WHERE i.batch_key = e.batch_key AND reached <= layer + 1) num_src FROM (SELECT batch_key, 0 layer, count(*) num_edge FROM l0 GROUP BY 1 UNION ALL SELECT batch_key, 1, count(*) FROM l1 GROUP BY 1) e", **TWO))
def p2_layer_sizes(spark, sf_dir):
    """Edges, destination nodes and source nodes of each block."""
    return two_layers(spark, sf_dir)[2].sizes()


@query(with_(["edges", "frontier"], "SELECT e.batch_key, e.layer, count(*) num_edge, count(DISTINCT e.dst) num_sampled, count(DISTINCT e.src) num_neighbour FROM (SELECT *, 0 layer FROM l0 UNION ALL SELECT *, 1 FROM l1) e GROUP BY 1, 2", **TWO))
def p1_block_sizes(spark, sf_dir):
    e = two_layers(spark, sf_dir)[2].edges
    one = lambda c: e.select("batch_key", "layer", c).distinct().groupBy("batch_key", "layer")
    edges = e.groupBy("batch_key", "layer").agg(F.count("*").alias("num_edge"))
    return edges.join(one("dst").agg(F.count("*").alias("num_sampled")), ["batch_key", "layer"]).join(one("src").agg(F.count("*").alias("num_neighbour")), ["batch_key", "layer"])


@query(with_(["deg"], "SELECT node_id, row_number() OVER (ORDER BY out_degree DESC, node_id DESC) - 1 AS rank FROM deg"))
def f1_rank_degree(spark, sf_dir):
    return cache.rank_degree(_degrees(market.market(spark, sf_dir)))


@query(with_(["edges", "train", "deg"], "SELECT node_id, tier, row_number() OVER (ORDER BY tier, CASE WHEN tier = 2 THEN -out_degree ELSE 0 END, CASE WHEN tier = 2 THEN -node_id ELSE node_id END) - 1 AS rank FROM t",
             t="SELECT node_id, out_degree, CASE WHEN node_id IN (SELECT node_id FROM train) THEN 0 WHEN node_id IN (SELECT src FROM edges WHERE dst IN (SELECT node_id FROM train)) THEN 1 ELSE 2 END tier FROM deg"))
def f2_rank_heuristic(spark, sf_dir):
    g = market.market(spark, sf_dir)
    return cache.rank_heuristic(g.nodes, g.edges, market.train_set(g), _degrees(g))


@query(with_(["edges", "train", "deg"], "SELECT node_id, touched, row_number() OVER (ORDER BY touched DESC, value DESC, node_id DESC) - 1 AS rank FROM r",
             t1="SELECT node_id FROM train UNION SELECT src FROM edges WHERE dst IN (SELECT node_id FROM train)", t2="SELECT node_id FROM t1 UNION SELECT src FROM edges WHERE dst IN (SELECT node_id FROM t1)",
             sub="SELECT src node_id, count(*) n FROM edges WHERE dst IN (SELECT node_id FROM t2) GROUP BY 1",
             r="SELECT d.node_id, d.node_id IN (SELECT node_id FROM t2) touched, CASE WHEN d.node_id IN (SELECT node_id FROM t2) THEN coalesce(n, 0) ELSE out_degree END AS value FROM deg d LEFT JOIN sub USING (node_id)"))
def f3_rank_degree_hop(spark, sf_dir):
    """Two hops from the whole training set."""
    g = market.market(spark, sf_dir)
    return cache.rank_degree_hop(g.nodes, g.edges, market.train_set(g), _degrees(g))


@query(with_(["edges", "everyone", "nodes"], "SELECT node_id, freq, row_number() OVER (ORDER BY freq DESC, node_id DESC) - 1 AS rank FROM (SELECT n.node_id, count(i.node_id) freq FROM nodes n LEFT JOIN ids i USING (node_id) GROUP BY 1)", **layered("everyone", [10, 5])))
def f4_rank_presample(spark, sf_dir):
    g, _, r = two_layers(spark, sf_dir, True)
    return cache.rank_presample(g.nodes, r.inputs())


@query(with_(["edges", "everyone", "nodes"], "SELECT node_id, freq, row_number() OVER (ORDER BY freq DESC, node_id DESC) - 1 AS rank FROM (SELECT n.node_id, count(i.node_id) freq FROM nodes n LEFT JOIN h2 i USING (node_id) GROUP BY 1)",
             h1="SELECT batch_key, node_id FROM everyone UNION SELECT batch_key, src FROM everyone JOIN edges ON dst = node_id", h2="SELECT batch_key, node_id FROM h1 UNION SELECT batch_key, src FROM h1 JOIN edges ON dst = node_id"))
def f5_rank_presample_all(spark, sf_dir):
    """All neighbours over both layers of every batch of both epochs."""
    g, b = batches(spark, sf_dir)
    near = sampling.all_neighbour_frontier(g.edges, b.select("batch_key", "node_id"), 1)
    return cache.rank_frequency(g.nodes, reach.last_hop(g.edges, near))


@query(with_(["edges", "train", "deg"], "SELECT node_id, round(sum(hit), 4) visits FROM (SELECT seed, node_id, CASE WHEN max(CASE WHEN 1 - p <= 1e-12 THEN 1 ELSE 0 END) = 1 THEN 1.0::DOUBLE ELSE 1 - exp(sum(CASE WHEN 1 - p > 1e-12 THEN ln(1 - p) ELSE 0 END)) END hit FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE seed <> node_id GROUP BY 1, 2 UNION ALL SELECT node_id, node_id, 1.0::DOUBLE FROM train) GROUP BY 1",
             ch="SELECT dst, src, least(1.0::DOUBLE, 10.0::DOUBLE / in_degree) p1, least(1.0::DOUBLE, 25.0::DOUBLE / in_degree) p0 FROM edges JOIN deg ON node_id = dst",
             one="SELECT node_id seed, src node_id, p1 p FROM train JOIN ch ON dst = node_id", two="SELECT seed, src node_id, p * p0 FROM one JOIN ch ON dst = node_id"))
def f6_expected_visits(spark, sf_dir):
    g = market.market(spark, sf_dir)
    v = cache.expected_visits(g.edges, _degrees(g), market.train_set(g), simple=g.simple)
    return v.select("node_id", F.round("visits", 4).alias("visits"))


@query(with_(["nodes"], f"SELECT node_id, row_number() OVER (ORDER BY {md5(13, 'node_id')}, node_id) - 1 AS rank FROM nodes"))
def f7_rank_random(spark, sf_dir):
    return cache.rank_random(market.market(spark, sf_dir).nodes, 13)


@query(with_(["deg"], CACHED))
def f9_build_cache(spark, sf_dir):
    return _cached(market.market(spark, sf_dir))[0]


@query(with_(["frontier", "nodes"], """SELECT batch_key, node_id, row_number() OVER (PARTITION BY batch_key ORDER BY node_id) - 1 cache_pos, label
 FROM (SELECT DISTINCT batch_key, node_id FROM frontier) JOIN nodes USING (node_id)"""))
def f10_replace_cache(spark, sf_dir):
    """The cache that each batch of the epoch puts in place of the one before."""
    g, f = frontier(spark, sf_dir)
    return cache.replace_cache(g.nodes.select("node_id", "label"), f.select("batch_key", "node_id")).select("batch_key", "node_id", "cache_pos", "label")


#: The layers over every batch of the epoch.
EPOCH = ["batch_key"]
EPOCH_MSG = "SELECT e.batch_key, e.dst, d.i, CAST(n.feat[d.i] AS DOUBLE) x {more} FROM e JOIN nodes n ON n.node_id = e.src {join} CROSS JOIN (SELECT unnest(range(1, 65)) i) d"


def _epoch_edges(spark, sf_dir):
    g, f = frontier(spark, sf_dir)
    return g, sampling.khop_places(g.lists, f, 10, SEED, degrees=g.degrees).select("batch_key", "src", "dst")


def _flat_epoch(out):
    return out.select("batch_key", "node_id", F.posexplode("out").alias("dim", "x"))


@query(with_(["edges", "frontier", "nodes"], "SELECT batch_key, dst node_id, i - 1 dim, round(sum(x * n), 6) x FROM m GROUP BY 1, 2, 3", e=khop("frontier", 10, 0),
             o="SELECT batch_key, src, pow(count(*), -0.5) a FROM e GROUP BY 1, 2", q="SELECT batch_key, dst, pow(count(*), -0.5) b FROM e GROUP BY 1, 2",
             m=EPOCH_MSG.format(more=", a * b n", join="JOIN o ON o.batch_key = e.batch_key AND o.src = e.src JOIN q ON q.batch_key = e.batch_key AND q.dst = e.dst")))
def l1_gcn(spark, sf_dir):
    g, e = _epoch_edges(spark, sf_dir)
    return _flat_epoch(layers.gcn(e, g.nodes, EPOCH))


@query(with_(["edges", "frontier", "nodes"], "SELECT batch_key, dst node_id, i - 1 dim, round(avg(x), 6) x FROM m GROUP BY 1, 2, 3", e=khop("frontier", 10, 0), m=EPOCH_MSG.format(more="", join="")))
def l3_sage_mean(spark, sf_dir):
    g, e = _epoch_edges(spark, sf_dir)
    return _flat_epoch(layers.sage_mean(e, g.nodes, EPOCH))


@query(with_(["adj", "frontier", "nodes"], "SELECT batch_key, node_id, dim, round(x / CASE WHEN sqrt(sum(x * x) OVER w) = 0 THEN 1 ELSE sqrt(sum(x * x) OVER w) END, 6) x FROM v WINDOW w AS (PARTITION BY batch_key, node_id)", **WALK,
             e="SELECT batch_key, src, dst, w FROM top", m=EPOCH_MSG.format(more=", e.w", join=""),
             v="SELECT batch_key, dst node_id, i + 63 dim, sum(x * w) / greatest(sum(w), 1) x FROM m GROUP BY 1, 2, 3 UNION ALL SELECT batch_key, node_id, i - 1, CAST(feat[i] AS DOUBLE) FROM nodes JOIN (SELECT DISTINCT batch_key, dst FROM e) ON dst = node_id CROSS JOIN (SELECT unnest(range(1, 65)) i)"))
def l4_pin_sage(spark, sf_dir):
    g, _, visits = _visits(spark, sf_dir)
    top = sampling.visit_topk(visits, TOP).select("batch_key", "src", "dst", "w")
    return _flat_epoch(layers.pin_sage(top, g.nodes, EPOCH))


@query(with_(["edges", "frontier", "nodes"], "SELECT batch_key, dst node_id, i - 1 dim, round(sum(x * p), 6) x FROM m GROUP BY 1, 2, 3", s=khop("frontier", 10, 0),
             sc="SELECT s.batch_key, s.src, s.dst, CAST(a.feat[1] AS DOUBLE) + CAST(b.feat[2] AS DOUBLE) s FROM s JOIN nodes a ON a.node_id = s.src JOIN nodes b ON b.node_id = s.dst",
             e="SELECT batch_key, src, dst, exp(l) / sum(exp(l)) OVER (PARTITION BY batch_key, dst) p FROM (SELECT *, CASE WHEN s > 0 THEN s ELSE s * 0.2::DOUBLE END l FROM sc)",
             m=EPOCH_MSG.format(more=", e.p", join="")))
def l5_attention(spark, sf_dir):
    g, e = _epoch_edges(spark, sf_dir)
    scores = g.nodes.select("node_id", F.col("feat")[0].cast("double").alias("left"), F.col("feat")[1].cast("double").alias("right"))
    return _flat_epoch(layers.attention(e, g.nodes, scores, EPOCH))


@query(with_(["edges", "frontier", "nodes"], "SELECT batch_key, dst node_id, 64 * h + i - 1 dim, round(sum(x * p), 6) x FROM m GROUP BY 1, 2, 3", s=khop("frontier", 10, 0),
             sc="SELECT h, s.batch_key, s.src, s.dst, CAST(a.feat[h + 1] AS DOUBLE) + CAST(b.feat[h + 3] AS DOUBLE) s FROM s JOIN nodes a ON a.node_id = s.src JOIN nodes b ON b.node_id = s.dst CROSS JOIN (SELECT unnest([0, 1]) h)",
             e="SELECT h, batch_key, src, dst, exp(l) / sum(exp(l)) OVER (PARTITION BY h, batch_key, dst) p FROM (SELECT *, CASE WHEN s > 0 THEN s ELSE s * 0.2::DOUBLE END l FROM sc)",
             m="SELECT e.batch_key, e.dst, e.h, d.i, CAST(n.feat[d.i] AS DOUBLE) x, e.p FROM e JOIN nodes n ON n.node_id = e.src CROSS JOIN (SELECT unnest(range(1, 65)) i) d").replace("GROUP BY 1, 2, 3", "GROUP BY 1, 2, h, i"))
def l5_attention_heads(spark, sf_dir):
    """Two heads, one after the other."""
    g, e = _epoch_edges(spark, sf_dir)
    x = lambda i: F.col("feat")[i].cast("double")
    scores = g.nodes.select("node_id", F.array(x(0), x(1)).alias("left"), F.array(x(2), x(3)).alias("right"))
    return _flat_epoch(layers.attention(e, g.nodes, scores, EPOCH))


@query(f"SELECT CAST(p_partkey AS BIGINT) node_id, {md5(SEED, 'p_partkey')} AS draw FROM part")
def c16_draw_order(spark, sf_dir):
    part = market.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("node_id"))
    return part.select("node_id", draw(SEED, F.col("node_id")).alias("draw"))


@query("SELECT p_partkey k, CAST(p_partkey * 11 * 2 AS BIGINT) frontier, CAST(p_partkey * 6 * 3 * 4 * 5 AS BIGINT) walk_edges, CAST(pow(2, floor(log2(greatest(p_partkey, 1))) + 2) AS BIGINT) slots FROM part")
def c17_predictors(spark, sf_dir):
    """Upper bounds of a frontier of fanouts 1 and 10, of a walk layer and of a table, for each part's number of seeds."""
    from ..functions import scalar

    k = F.col("p_partkey").cast("long")
    part = market.read(spark, sf_dir, "part").select(k.alias("k"))
    k = F.col("k")
    return part.select("k", scalar.predict_nodes(k, [1, 10]).alias("frontier"), scalar.predict_walk_edges(k, [9, 2, 5], 4, 5).alias("walk_edges"), scalar.slots(k).alias("slots"))


RECORDS = f"""SELECT batch_key, 'edge' part, CAST(layer AS INTEGER) layer, "row" a, col b, NULL::DOUBLE x FROM ({BLOCKS})
 UNION ALL SELECT batch_key, 'node', CAST(reached AS INTEGER), local_id, node_id, NULL FROM ids
 UNION ALL SELECT batch_key, 'about', 0, local_id, CASE WHEN reached = 0 THEN label END, {MOMENT} FROM ids JOIN nodes USING (node_id)
 UNION ALL SELECT batch_key, 'cache', 0, local_id, cache_pos, NULL FROM ids LEFT JOIN cached USING (node_id)"""


def _records(spark, sf_dir) -> str:
    """The epoch's batches written as records; returns their folder."""
    g, _, r = two_layers(spark, sf_dir)
    c, n = _cached(g)
    folder = f"{shared_root(spark)}/records-{uuid.uuid4().hex}"
    records.write_batches(r, folder, g.nodes, gather.cache_split(r.inputs(), c, n), chunk_bytes=1 << 16)
    return folder


def _told(rows):
    return rows.select("batch_key", "part", "layer", "a", "b", _moment("x").alias("x"))


@query(with_(["edges", "frontier", "nodes", "deg"], RECORDS, **TWO, cached=CACHED))
def j7_batch_records(spark, sf_dir):
    """Every batch of the epoch written as a record in chunks, and restored: nodes, layers, features, labels, cache places."""
    return _told(records.read_batches(spark, _records(spark, sf_dir)))


@query(with_(["edges", "frontier", "nodes", "deg"], RECORDS, **TWO, cached=CACHED))
def o3_ready_batches(spark, sf_dir):
    """The same batches handed out by a stream, eight in flight."""
    folder = _records(spark, sf_dir)
    records.drain(spark, folder, f"{folder}-out", f"{folder}-state", in_flight=8)
    return _told(spark.read.parquet(f"{folder}-out"))


def _views(spark, sf_dir) -> None:
    g, f = frontier(spark, sf_dir)
    sql_surface.register(spark, g, "market")
    f.createOrReplaceTempView("market_frontier")


SAMPLE = f"""sample_neighbours(TABLE(SELECT f.batch_key, l.dst, l.pos, l.src, l.deg FROM market_frontier f JOIN market_lists l ON l.dst = f.node_id)
 PARTITION BY (batch_key, dst), 10, {SEED})"""


@query(with_(["adj", "frontier"], "SELECT batch_key, dst, src FROM s", s=khop("frontier", 10, 0)))
def p3_sql_sample(spark, sf_dir):
    """Neighbours sampled by a table function in SQL: the same as by the sampler."""
    _views(spark, sf_dir)
    return spark.sql(f"SELECT batch_key, dst, src FROM {SAMPLE}")


@query(with_(["adj", "frontier", "nodes"], "SELECT batch_key, label, count(*) num_edge, count(DISTINCT src) num_node FROM s JOIN nodes ON node_id = src GROUP BY 1, 2", s=khop("frontier", 10, 0)))
def p4_sql_labels(spark, sf_dir):
    """What labels each batch's sampled neighbours have."""
    _views(spark, sf_dir)
    return spark.sql(f"SELECT batch_key, label, count(*) num_edge, count(DISTINCT src) num_node FROM {SAMPLE} s JOIN market_nodes ON node_id = src GROUP BY batch_key, label")


@query(with_(["deg", "train"], "SELECT node_id IN (SELECT node_id FROM train) AS trained, max(in_degree) max_in, CAST(sum(out_degree) AS BIGINT) sum_out, count(*) num_node FROM deg GROUP BY 1"))
def p5_sql_degrees(spark, sf_dir):
    """Degrees of training nodes and of the others."""
    _views(spark, sf_dir)
    return spark.sql("""SELECT s.node_id IS NOT NULL AS trained, max(in_degree) max_in, sum(out_degree) sum_out, count(*) num_node
 FROM market_degrees d LEFT JOIN (SELECT node_id FROM market_splits WHERE split = 'train') s ON s.node_id = d.node_id GROUP BY 1""")


@query(with_(["adj", "frontier", "deg"], "SELECT batch_key, node_id, cache_pos, cache_pos IS NOT NULL is_hit FROM ids LEFT JOIN cached USING (node_id)", **TWO, cached=CACHED))
def e6_cache_bitmaps(spark, sf_dir):
    """The hits of e6_cache_split as a cache of any size tells them: by bits, only hits meeting the table of places."""
    g, _, r = two_layers(spark, sf_dir)
    return gather.cache_split(r.inputs().select("batch_key", "node_id"), _cached(g)[0], gather.BROADCAST_ROWS + 1)
