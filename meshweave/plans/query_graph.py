"""Queries over graph sources, construction, checks, degrees and scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.rand import u32
from ..functions.ranks import global_rank
from ..operators import analytics, build, checks
from ..sources import dataset, files, market, npz, webgraph
from .declare import query
from .sql import md5, with_
from .sql import u32 as sql_u32
from .storage import materialise, shared_root

def _folder(spark, what: str) -> str:
    """A new folder for a query that writes files and reads them back."""
    import uuid

    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def _degrees(spark, sf_dir):
    g = market.market(spark, sf_dir)
    return g, g.degrees


@query(with_(["size", "edges", "train", "nodes"], """SELECT unnest(['NUM_NODE', 'NUM_EDGE', 'FEAT_DIM', 'NUM_CLASS', 'NUM_TRAIN_SET', 'NUM_TEST_SET', 'NUM_VALID_SET']) AS key,
 unnest([(SELECT CAST(p + s + c AS BIGINT) FROM size), (SELECT count(*) FROM edges), 64, (SELECT max(label) + 1 FROM nodes), (SELECT count(*) FROM train), (SELECT count(*) FROM part WHERE p_partkey % 10 = 2), (SELECT count(*) FROM part WHERE p_partkey % 10 = 1)]) AS value"""))
def a1_meta(spark, sf_dir):
    """The metadata file of a dataset folder, written from the market graph and read as text."""
    folder = _folder(spark, "meta")
    files.write_meta(spark, dataset.metadata(market.market(spark, sf_dir)), f"{folder}/meta.txt")
    return files.parse_meta(spark.read.text(f"{folder}/meta.txt"))


@query(with_(["edges"], "SELECT src, dst FROM edges"))
def a2_binary_roundtrip(spark, sf_dir):
    """Edges written as an array of interleaved pairs and read back in byte ranges."""
    g, folder = market.market(spark, sf_dir), _folder(spark, "coo")
    files.write_array(build.edge_places(g.lists).select("at", F.array("src", "dst").alias("pair")), f"{folder}/coo.bin", "u32", "at", "pair")
    return files.read_coo(spark, f"{folder}/coo.bin", split=1 << 20)


@query(with_(["nodes", "edges", "train"], "SELECT (SELECT count(*) FROM nodes) num_node, (SELECT count(*) FROM edges) num_edge, (SELECT count(*) FROM train) num_train, (SELECT count(DISTINCT label) FROM nodes) num_class"))
def a3_load_graph(spark, sf_dir):
    """Counts of a dataset folder that was written from the market graph and opened again."""
    folder = _folder(spark, "dataset")
    dataset.write_graph(market.market(spark, sf_dir), folder)
    g = dataset.load_graph(spark, folder).graph
    nodes = g.nodes.agg(F.count("*").alias("num_node"), F.countDistinct("label").alias("num_class"))
    return nodes.crossJoin(g.edges.agg(F.count("*").alias("num_edge"))).crossJoin(market.train_set(g).agg(F.count("*").alias("num_train")))


@query(with_(["edges", "deg", "nodes"], "SELECT src, dst, b.in_degree dst_degree, a.out_degree src_degree, n.label dst_label, round(CAST(n.feat[64] AS DOUBLE), 6) dst_feat FROM edges JOIN deg a ON a.node_id = src JOIN deg b ON b.node_id = dst JOIN nodes n ON n.node_id = dst"))
def a4_dataset_folder(spark, sf_dir):
    """Every edge of a dataset folder opened from its 64-bit arrays, with degrees, labels and features from their files."""
    folder, g = _folder(spark, "dataset"), market.market(spark, sf_dir)
    dataset.write_graph(g, folder, degrees=g.degrees, wide=True)
    d = dataset.load_graph(spark, folder, wide=True)
    out = d.degrees.select(F.col("node_id").alias("src"), F.col("out_degree").alias("src_degree"))
    ins = d.degrees.select(F.col("node_id").alias("dst"), F.col("in_degree").alias("dst_degree"))
    about = d.graph.nodes.select(F.col("node_id").alias("dst"), F.col("label").alias("dst_label"), F.round(F.element_at("feat", -1).cast("double"), 6).alias("dst_feat"))
    return d.graph.edges.join(out, "src").join(ins, "dst").join(about, "dst")


@query(with_(["deg"], "SELECT node_id, row_number() OVER (ORDER BY out_degree DESC, node_id DESC) - 1 AS rank FROM deg"))
def a16_ranking_file(spark, sf_dir):
    """A ranking written as an array of nodes and read back with a dataset folder."""
    from ..operators import cache

    folder, g = _folder(spark, "dataset"), market.market(spark, sf_dir)
    dataset.write_graph(g, folder, {"degree": cache.rank_degree(g.degrees)})
    return dataset.load_graph(spark, folder).rankings["degree"].select("node_id", "rank")


@query(with_(["edges"], "SELECT count(*) num_edge, (SELECT count(*) FROM (SELECT DISTINCT dst FROM edges)) num_list, true AS fits FROM edges"))
def b11_offsets(spark, sf_dir):
    """The written offsets start at 0, never fall and end at the number of edges."""
    folder, g = _folder(spark, "csc"), market.market(spark, sf_dir)
    files.write_csc(g.edges, g.num_nodes, folder)
    indptr = files.read_array(spark, f"{folder}/indptr.bin", "u32", g.num_nodes + 1)
    lists = dataset.list_places(indptr, g.num_nodes).agg(F.count("*").alias("num_edge"), F.countDistinct("dst").alias("num_list"))
    return checks.offsets_fit(indptr, g.num_nodes, g.edges.count()).crossJoin(lists).select("num_edge", "num_list", "fits")


@query("SELECT CAST(p_partkey AS BIGINT) p_partkey, p_name, p_retailprice FROM part")
def a7_csv_gz(spark, sf_dir):
    """Rows written as compressed CSV without a header and read under a schema."""
    path = _folder(spark, "csv")
    market.read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").write.csv(path, compression="gzip")
    return files.read_csv(spark, path, "p_partkey long, p_name string, p_retailprice double")


@query("""SELECT CAST(l_partkey AS BIGINT) src, CAST(l_suppkey AS BIGINT) dst, round(p_retailprice * 0.5::DOUBLE, 4) x, CAST(p_size AS DOUBLE) y
 FROM lineitem JOIN part ON l_partkey = p_partkey""")
def a8_npz(spark, sf_dir):
    """All pairs of the line items as an index of two rows, and features of all parts, through one NPZ file."""
    path = f"{_folder(spark, 'npz')}/graph.npz"
    pairs = market.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("src"), F.col("l_suppkey").cast("long").alias("dst"))
    placed = materialise(global_rank(pairs, [F.col("src"), F.col("dst")], "pos"), "npz-pairs")
    n = placed.count()
    both = placed.select(F.posexplode(F.array("src", "dst")).alias("row", "value"), "pos")
    index = both.select((F.col("row") * F.lit(n).cast("long") + F.col("pos")).alias("pos"), "value")
    part = market.read(spark, sf_dir, "part")
    two = F.array(F.col("p_retailprice").cast("double") * 0.5, F.col("p_size").cast("double"))
    feat = part.select(F.col("p_partkey").cast("long").alias("pos"), two.alias("value"))
    npz.write_npz(spark, path, edge_index=(index, "i64", (2, n)), node_feat=(feat, "f64", (part.count(), 2)))
    x = npz.read_npz(spark, path, "node_feat", split=1 << 20).select(F.col("pos").alias("src"), F.round(F.col("value")[0], 4).alias("x"), F.col("value")[1].alias("y"))
    return npz.edges_from_npz(spark, path, split=1 << 20).join(x, "src").select("src", "dst", "x", "y")


@query(with_(["edges"], "SELECT src, dst FROM edges"))
def a10_webgraph(spark, sf_dir):
    """The market graph as a compressed web graph with references and runs, decoded step by step."""
    base, g = f"{_folder(spark, 'webgraph')}/market", market.market(spark, sf_dir)
    webgraph.write_webgraph(g.edges, g.num_nodes, base)
    return webgraph.read_webgraph(spark, base, step=512)


@query(with_(["deg"], "SELECT node_id, in_degree, out_degree FROM deg"))
def a17_degree_text(spark, sf_dir):
    """Degrees written as tab-separated text and read back."""
    path = _folder(spark, "degrees")
    files.write_degrees(market.market(spark, sf_dir).degrees, path, text=True)
    return spark.read.schema("node_id long, in_degree long, out_degree long").option("sep", "\t").csv(path)


@query(with_(["deg"], "SELECT in_degree degree, count(*) num_node FROM deg GROUP BY 1"))
def a22_tsv_report(spark, sf_dir):
    """A degree table written as a tab-separated report with a header and read back."""
    path = _folder(spark, "report")
    files.write_tsv(analytics.degree_histogram(market.market(spark, sf_dir).degrees).select("degree", "num_node"), path)
    return spark.read.option("sep", "\t").option("header", True).schema("degree long, num_node long").csv(path)


@query(with_(["adj"], "SELECT dst, pos // 100 chunk, array_to_string(list(src ORDER BY pos), ',') neighbours FROM adj GROUP BY 1, 2"))
def a6_adjacency(spark, sf_dir):
    """Lists in rows of at most a hundred neighbours."""
    rows = build.chunked_lists(market.market(spark, sf_dir).lists, 100)
    return rows.select("dst", "chunk", F.array_join("neighbours", ",").alias("neighbours"))


@query(with_(["edges"], "SELECT src, dst FROM edges"))
def a9_edge_text(spark, sf_dir):
    """Edges written as text lines and read back by the text source."""
    path = _folder(spark, "edges")
    market.market(spark, sf_dir).edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(path)
    return files.read_edge_text(spark, path)


@query(with_(["edges"], "SELECT src, dst FROM edges"))
def a13_coo_sink(spark, sf_dir):
    return materialise(market.market(spark, sf_dir).edges.select("src", "dst"), "coo")


@query("SELECT CAST(p_partkey AS BIGINT) p_partkey, CAST(p_size AS BIGINT) p_size FROM part")
def a15_widen(spark, sf_dir):
    part = market.read(spark, sf_dir, "part")
    return files.widen(part.select(F.col("p_partkey").cast("int"), "p_size"), "p_partkey", "p_size")


@query(with_(["nodes"], "SELECT n.node_id, round(CAST(t.feat[1] AS DOUBLE), 6) f0 FROM nodes n JOIN nodes t ON t.node_id = n.node_id & 127"))
def a23_mock_features(spark, sf_dir):
    from ..operators.gather import gather

    g = market.market(spark, sf_dir)
    table = g.nodes.where("node_id < 128").select("node_id", "feat")
    return gather(table, g.nodes.select("node_id"), "feat", mask=127).select("node_id", F.round(F.col("feat")[0].cast("double"), 6).alias("f0"))


@query(with_(["edges"], "SELECT src, dst FROM edges"))
def b1_symmetrise(spark, sf_dir):
    pairs = market.market_pairs(spark, sf_dir)[0]
    return build.symmetrise(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))


@query(with_(["trail"], "SELECT dst AS src, src AS dst FROM trail"))
def b2_transpose(spark, sf_dir):
    return build.transpose(market.trail(spark, sf_dir).edges)


@query(with_(["adj"], "SELECT dst, pos, src, deg FROM adj"))
def b3_positions(spark, sf_dir):
    return build.with_positions(market.market(spark, sf_dir).edges)


@query(with_(["adj", "deg"], "SELECT dst, pos, src, adj.deg, CAST(sum(out_degree) OVER (PARTITION BY dst ORDER BY pos) AS DOUBLE) prefix FROM adj JOIN deg ON node_id = src"))
def b3_positions_of_hubs(spark, sf_dir):
    """Places and running sums of lists, range by range, as for lists too long for a task."""
    from ..operators import weights

    g = market.market(spark, sf_dir)
    weighted = g.edges.join(g.degrees.select(F.col("node_id").alias("src"), F.col("out_degree").cast("double").alias("w")), "src")
    return weights.prefix_table(weighted, hubs=True).select("dst", "pos", "src", "deg", "prefix")


@query(with_(["deg"], "SELECT node_id, CAST(coalesce(sum(in_degree) OVER (ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM deg"))
def b4_offsets(spark, sf_dir):
    return build.offsets(_degrees(spark, sf_dir)[1])


@query("SELECT DISTINCT CAST(l_partkey AS BIGINT) src, CAST(l_suppkey AS BIGINT) dst FROM lineitem")
def b5_collapse(spark, sf_dir):
    items = market.read(spark, sf_dir, "lineitem")
    return build.collapse(items.select(F.col("l_partkey").cast("long").alias("src"), F.col("l_suppkey").cast("long").alias("dst")))


@query("WITH used AS (SELECT DISTINCT l_orderkey id FROM lineitem UNION SELECT DISTINCT l_partkey + 10000000 FROM lineitem), d AS (SELECT id, row_number() OVER (ORDER BY id) - 1 n FROM used) SELECT a.n src, b.n dst FROM lineitem JOIN d a ON a.id = l_orderkey JOIN d b ON b.id = l_partkey + 10000000")
def b6_compact_ids(spark, sf_dir):
    items = market.read(spark, sf_dir, "lineitem")
    edges = items.select(F.col("l_orderkey").cast("long").alias("src"), (F.col("l_partkey").cast("long") + 10_000_000).alias("dst"))
    ids = edges.select(F.explode(F.array("src", "dst")).alias("old_id"))
    return build.remap(edges, build.id_dictionary(ids))


@query(with_(["deg"], """SELECT node_id, CASE WHEN rk < n // 4 THEN 'train' WHEN rk < n // 4 + n // 10 THEN 'test' ELSE 'valid' END split,
 CASE WHEN rk < n // 4 THEN rk WHEN rk < n // 4 + n // 10 THEN rk - n // 4 ELSE rk - n // 4 - n // 10 END pos FROM ranked WHERE rk < n // 4 + n // 10 + n // 20""",
             ranked=f"SELECT node_id, row_number() OVER (ORDER BY {md5(3, 'node_id')}, node_id) - 1 rk, count(*) OVER () n FROM deg WHERE in_degree > 0"))
def b7_random_splits(spark, sf_dir):
    """A quarter, a tenth and a twentieth of the nodes with neighbours."""
    deg = _degrees(spark, sf_dir)[1]
    n = deg.where("in_degree > 0").count()
    return build.random_splits(deg, {"train": n // 4, "test": n // 10, "valid": n // 20}, 3)


@query("SELECT CAST(p_partkey AS BIGINT) node_id, CASE p_partkey % 5 WHEN 1 THEN 'train' WHEN 2 THEN 'valid' ELSE 'test' END split FROM part WHERE p_partkey % 5 IN (1, 2, 3)")
def b8_splits_by_type(spark, sf_dir):
    part = market.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("node_id"))
    return build.splits_by_type(part, F.col("node_id") % 5)


@query(with_(["edges", "size"], "SELECT max(greatest(src, dst)) max_id, max(greatest(src, dst)) < (SELECT p + s + c FROM size) in_range FROM edges"))
def b9_id_range(spark, sf_dir):
    g = market.market(spark, sf_dir)
    return checks.id_range(g.edges, g.num_nodes)


@query(with_(["edges"], "SELECT count(*) num_edge, true AS matches FROM edges"))
def b10_row_counts(spark, sf_dir):
    g = market.market(spark, sf_dir)
    return checks.row_counts(g.edges, 2 * market.market_pairs(spark, sf_dir)[0].count())


@query(with_(["edges"], "SELECT id node_id, count(*) uses FROM (SELECT src id FROM edges UNION ALL SELECT dst FROM edges) WHERE id % 97 = 0 GROUP BY 1"))
def b11_endpoints(spark, sf_dir):
    g = market.market(spark, sf_dir)
    return checks.endpoints_outside(g.edges, g.nodes.where("node_id % 97 <> 0"))


@query("SELECT CAST(l_partkey AS BIGINT) src, CAST(l_suppkey AS BIGINT) dst, count(*) copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def b12_duplicate_edges(spark, sf_dir):
    items = market.read(spark, sf_dir, "lineitem")
    return checks.duplicate_edges(items.select(F.col("l_partkey").cast("long").alias("src"), F.col("l_suppkey").cast("long").alias("dst")))


@query(with_(["train"], "SELECT count(*) num_sentinel FROM train WHERE node_id = 4294967295 OR node_id IS NULL"))
def b13_sentinels(spark, sf_dir):
    return checks.sentinels(market.train_set(market.market(spark, sf_dir))).agg(F.count("*").alias("num_sentinel"))


@query(with_(["edges", "trail"], "SELECT 'market' graph, count(*) num_reciprocal FROM edges a WHERE EXISTS (SELECT 1 FROM edges b WHERE b.src = a.dst AND b.dst = a.src) UNION ALL SELECT 'trail', count(*) FROM trail a WHERE EXISTS (SELECT 1 FROM trail b WHERE b.src = a.dst AND b.dst = a.src)"))
def b14_reciprocal(spark, sf_dir):
    one = lambda name, g: checks.reciprocal_edges(g.edges).agg(F.count("*").alias("num_reciprocal")).select(F.lit(name).alias("graph"), "num_reciprocal")
    return one("market", market.market(spark, sf_dir)).unionAll(one("trail", market.trail(spark, sf_dir)))


@query("SELECT n_nationkey src, n_regionkey dst FROM nation WHERE n_nationkey = n_regionkey")
def b16_self_loops(spark, sf_dir):
    nation = market.read(spark, sf_dir, "nation")
    return checks.self_loops(nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst")))


@query("SELECT event_id node_id FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) src FROM events) WHERE src IS NULL")
def b17_zero_degree(spark, sf_dir):
    g = market.trail(spark, sf_dir)
    return checks.without_neighbours(g.nodes, g.edges)


@query("SELECT DISTINCT dst FROM (SELECT CAST(l_suppkey AS BIGINT) dst, l_partkey src, lag(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) prev FROM lineitem) WHERE prev > src")
def b18_unsorted_lists(spark, sf_dir):
    items = market.read(spark, sf_dir, "lineitem")
    pos = F.col("l_orderkey").cast("long") * 100 + F.col("l_linenumber").cast("long")
    return checks.unsorted_lists(items.select(F.col("l_suppkey").cast("long").alias("dst"), F.col("l_partkey").cast("long").alias("src"), pos.alias("pos")))


@query(with_(["batches"], "SELECT batch_key, count(*) num_rows, count(DISTINCT node_id) num_distinct, CAST(0 AS BIGINT) num_sentinel FROM batches GROUP BY 1"))
def b19_batch_faults(spark, sf_dir):
    from .query_samples import batches

    return checks.batch_faults(batches(spark, sf_dir)[1])


@query(with_(["edges", "train"], "SELECT src, dst FROM edges WHERE dst IN (SELECT node_id FROM train)"))
def b20_induced_rows(spark, sf_dir):
    g = market.market(spark, sf_dir)
    return build.induced_rows(g.edges, market.train_set(g))


@query(with_(["deg"], "SELECT node_id, in_degree, out_degree FROM deg"))
def g1_degrees(spark, sf_dir):
    g = market.market(spark, sf_dir)
    return build.degrees(g.nodes, g.edges)


@query(with_(["deg"], """SELECT degree, num_node, round(num_node * 100.0::DOUBLE / sum(num_node) OVER (), 6) node_pct, round(sum(num_node) OVER w * 100.0::DOUBLE / sum(num_node) OVER (), 6) cum_node_pct,
 round(num_node * degree * 100.0::DOUBLE / sum(num_node * degree) OVER (), 6) edge_pct, round(sum(num_node * degree) OVER w * 100.0::DOUBLE / sum(num_node * degree) OVER (), 6) cum_edge_pct
 FROM (SELECT in_degree degree, count(*) num_node FROM deg GROUP BY 1) WINDOW w AS (ORDER BY degree DESC ROWS UNBOUNDED PRECEDING)"""))
def g2_degree_histogram(spark, sf_dir):
    return analytics.degree_histogram(_degrees(spark, sf_dir)[1])


@query(with_(["deg"], "SELECT row_number() OVER (ORDER BY in_degree DESC, node_id DESC) - 1 place, node_id, in_degree FROM deg"))
def g3_nodes_by_degree(spark, sf_dir):
    return analytics.nodes_by_degree(_degrees(spark, sf_dir)[1])


@query(with_(["deg"], "SELECT max(in_degree) max_in_degree, max(out_degree) max_out_degree FROM deg"))
def g4_max_degree(spark, sf_dir):
    return analytics.max_degrees(_degrees(spark, sf_dir)[1])


@query(with_(["edges", "size"], "SELECT (p + s + c + 1 + (SELECT count(*) FROM edges)) * 4 topology_bytes, (p + s + c) * 64 * 4 feature_bytes FROM size"))
def g5_size_estimates(spark, sf_dir):
    g = market.market(spark, sf_dir)
    return analytics.size_estimates(g.num_nodes, g.edges.count(), 64, spark)


#: Far more hops than the market graph is wide, so that SQL comes to the fixpoint too.
FAR = 12


@query(with_(["edges", "train", "size"], """SELECT hop, CAST(sum(n) OVER (ORDER BY hop) AS BIGINT) num_node, round(sum(n) OVER (ORDER BY hop) * 100.0::DOUBLE / (SELECT p + s + c FROM size), 6) node_pct FROM (SELECT hop, count(*) n FROM (SELECT id, min(hop) hop FROM walk GROUP BY 1) GROUP BY 1)""",
             walk=f"SELECT node_id id, 0 hop FROM train UNION SELECT src, hop + 1 FROM walk JOIN edges ON dst = id WHERE hop < {FAR}"))
def g6_reach(spark, sf_dir):
    """From the training set of the market graph to the fixpoint."""
    g = market.market(spark, sf_dir)
    return analytics.reach_sizes(analytics.reach_by_hop(g.edges, market.train_set(g)), g.num_nodes)




@query(with_(["edges", "train", "size"], """SELECT hop, CAST(sum(n) OVER (ORDER BY hop) AS BIGINT) num_node, round(sum(n) OVER (ORDER BY hop) * 100.0::DOUBLE / (SELECT p + s + c FROM size), 6) node_pct FROM (SELECT hop, count(*) n FROM (SELECT id, min(hop) hop FROM walk GROUP BY 1) GROUP BY 1)""",
             few="SELECT node_id FROM train QUALIFY row_number() OVER (ORDER BY node_id) <= (SELECT count(*) // 8 FROM train)",
             walk=f"SELECT node_id id, 0 hop FROM few UNION SELECT src, hop + 1 FROM walk JOIN edges ON dst = id WHERE hop < {FAR}"))
def g6_reach_of_a_part(spark, sf_dir):
    """From the part of the training set that one of eight trainers has."""
    g = market.market(spark, sf_dir)
    part = analytics.first_part(market.train_set(g).withColumn("pos", F.col("node_id")), 8)
    return analytics.reach_sizes(analytics.reach_by_hop(g.edges, part), g.num_nodes)


@query("""WITH x AS (SELECT CAST(p_partkey AS BIGINT) k, CAST(p_partkey AS BIGINT) * p_partkey * 37 b FROM part)
 SELECT k, CASE WHEN b * 4096 > 1099511627776 THEN printf('%.2f TB', b * 4096 / 1099511627776.0::DOUBLE) WHEN b * 4096 > 1073741824 THEN printf('%.2f GB', b * 4096 / 1073741824.0::DOUBLE) WHEN b * 4096 > 1048576 THEN printf('%.2f MB', b * 4096 / 1048576.0::DOUBLE) WHEN b * 4096 > 1024 THEN printf('%.2f KB', b * 4096 / 1024.0::DOUBLE) ELSE printf('%.2f Bytes', (b * 4096)::DOUBLE) END with_tb,
 (k * 4611686018427 + 6) // 7 up_div_large, CASE WHEN b > 1073741824 THEN printf('%.2f GB', b / 1073741824.0::DOUBLE) WHEN b > 1048576 THEN printf('%.2f MB', b / 1048576.0::DOUBLE) WHEN b > 1024 THEN printf('%.2f KB', b / 1024.0::DOUBLE) ELSE printf('%.2f Bytes', b::DOUBLE) END readable,
 printf('%.2f %%', (k % 1000) / 1000.0::DOUBLE * 100) pct, (k + 6) // 7 up_div, (k + 6) // 7 * 7 up, k // 10 * 10 + k % 10 batch_key, k // 10 epoch, k % 10 step, (k << 32) | (k % 100) packed, k | 1073741824 flagged, k & 255 masked, k * 64 * 4 tensor_bytes FROM x""")
def m1_scalars(spark, sf_dir):
    k, b = F.col("k"), F.col("b")
    x = market.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k")).withColumn("b", k * k * 37)
    epoch, step = scalar.decode_key(k, F.lit(10))
    return x.select(
        "k", scalar.readable_bytes_to_tb(b * 4096).alias("with_tb"), scalar.round_up_div(k * 4611686018427, F.lit(7)).alias("up_div_large"), scalar.readable_bytes(b).alias("readable"), scalar.percentage((k % 1000) / F.lit(1000.0)).alias("pct"), scalar.round_up_div(k, F.lit(7)).alias("up_div"), scalar.round_up(k, F.lit(7)).alias("up"),
        scalar.encode_key(epoch, step, F.lit(10)).alias("batch_key"), epoch.alias("epoch"), step.alias("step"), scalar.pack_pair(k, k % 100).alias("packed"),
        k.bitwiseOR(F.lit(0x40000000)).alias("flagged"), k.bitwiseAND(F.lit(255)).alias("masked"), scalar.tensor_bytes(F.lit("f32"), F.array(k, F.lit(64).cast("long"))).alias("tensor_bytes"),
    )


@query("""SELECT p_partkey k, CASE WHEN p_partkey % 3 = 0 THEN 'cpu' ELSE 'cuda' END kind, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE CAST(p_size AS BIGINT) END num, p_size || ',' || (p_partkey % 11) || ',15' fanout, CAST(p_size + p_partkey % 11 + 15 AS INTEGER) total FROM part""")
def m8_parsing(spark, sf_dir):
    part, k = market.read(spark, sf_dir, "part"), F.col("p_partkey")
    device = F.when(k % 3 == 0, "cpu").otherwise(F.concat(F.lit("cuda:"), F.col("p_size").cast("string")))
    rows = part.select(k.alias("k"), device.alias("device"), F.concat(F.lit(" "), F.col("p_size"), F.lit("  "), k % 11, F.lit(" 15")).alias("text"))
    kind, num = scalar.parse_device(F.col("device"))
    fanout = scalar.parse_fanout(F.col("text"))
    return rows.select("k", kind.alias("kind"), num.alias("num"), F.array_join(fanout.cast("array<string>"), ",").alias("fanout"), F.aggregate(fanout, F.lit(0), lambda a, x: a + x).alias("total"))


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S') stamp FROM events")
def m10_stamp(spark, sf_dir):
    return market.read(spark, sf_dir, "events").select("event_id", scalar.stamp(F.col("ts")).alias("stamp"))


@query(f"SELECT CAST(p_partkey AS BIGINT) node_id, {sql_u32(11, 'p_partkey')} draw FROM part")
def c16_random_draws(spark, sf_dir):
    part = market.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("node_id"))
    return part.select("node_id", u32(11, F.col("node_id")).alias("draw"))


@query(with_(["train"], "SELECT node_id, 'both' AS side FROM (SELECT node_id FROM train INTERSECT SELECT p_partkey FROM part WHERE p_size > 25) UNION ALL SELECT node_id, 'only' FROM (SELECT node_id FROM train EXCEPT SELECT p_partkey FROM part WHERE p_size > 25)"))
def k1_set_operations(spark, sf_dir):
    train = market.train_set(market.market(spark, sf_dir))
    large = market.read(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").cast("long").alias("node_id"))
    return train.intersect(large).withColumn("side", F.lit("both")).unionAll(train.subtract(large).withColumn("side", F.lit("only")))
