"""Graphs held in the business tables: the market graph, the event trail, and their splits and features."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class Graph:
    """edges(src, dst): the in-neighbours of v are the rows with dst = v. nodes(node_id, label, feat).

    simple says that no edge is there twice. lists are the edges with their places (dst, pos, src,
    deg[, src_deg]) and degrees (node_id, in_degree, out_degree), where they are at hand already.
    hubs says that some list is longer than build.HUB_EDGES, so scans of lists go range by range.
    """

    nodes: DataFrame
    edges: DataFrame
    splits: DataFrame
    num_nodes: int
    simple: bool = False
    lists: DataFrame | None = None
    degrees: DataFrame | None = None
    hubs: bool = False


#: Tables of the graphs written so far, by application and folder: (bucketed tables' names, number of nodes).
_kept: dict[tuple[str, str], tuple[str, int, bool]] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def market_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Distinct (part, supplier) and (part, customer) pairs over one id space, and its size."""
    parts, suppliers, customers = (read(spark, sf_dir, t).count() for t in ("part", "supplier", "customer"))
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("long").alias("a"), F.col("l_suppkey").cast("long").alias("s"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("c"))
    sold = items.select("a", (F.col("s") + parts).alias("b"))
    bought = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("a", (F.col("c") + parts + suppliers).alias("b"))
    return sold.unionAll(bought).distinct(), parts + suppliers + customers


def build_market(spark: SparkSession, sf_dir: str) -> Graph:
    """The market graph as a plan over the tables of sf_dir: nothing is written."""
    from ..operators.build import symmetrise

    pairs, n = market_pairs(spark, sf_dir)
    edges = symmetrise(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    vectors = read(spark, sf_dir, "embeddings")
    m = vectors.count()
    ids = spark.range(n).select(F.col("id").alias("node_id"), (F.col("id") % m).alias("vec_id"))
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("feat"), F.col("label").cast("long").alias("label"))
    nodes = ids.join(vectors, "vec_id").select("node_id", "label", "feat")
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("node_id"))
    place = F.col("node_id") % 10
    splits = part.where(place < 3).select("node_id", F.when(place == 0, "train").when(place == 1, "valid").otherwise("test").alias("split"))
    return Graph(nodes, edges, splits, n, simple=True)


def market(spark: SparkSession, sf_dir: str) -> Graph:
    """The market graph, built and written on the first call for a folder and read back after that.

    Edges are bucketed by the node whose list they are in, nodes and degrees by their id, so joins and
    windows by node start without a shuffle of the graph. Lists are bucketed by node and place, so drawn
    places meet them without one, and a hub's list is spread over all buckets. forget() drops the tables, which is
    needed where the tables of sf_dir change while an application runs.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        _kept[key] = _write(spark, build_market(spark, sf_dir), read(spark, sf_dir, "lineitem").count())
    name, n, hubs = _kept[key]
    lists = spark.table(f"{name}_lists")
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("node_id"))
    place = F.col("node_id") % 10
    splits = part.where(place < 3).select("node_id", F.when(place == 0, "train").when(place == 1, "valid").otherwise("test").alias("split"))
    return Graph(spark.table(f"{name}_nodes"), spark.table(f"{name}_edges"), splits, n, True, lists, spark.table(f"{name}_degrees"), hubs)


#: Line items to a bucket (some four edges each), and the most buckets of a table.
BUCKET_ROWS, MOST_BUCKETS = 4_000_000, 50_000


def _write(spark: SparkSession, g: Graph, rows: int) -> tuple[str, int, bool]:
    from ..operators.build import HUB_EDGES, degrees, with_positions
    from ..plans.storage import shared_root

    name, buckets = f"graph_{uuid.uuid4().hex}", min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, rows // BUCKET_ROWS))

    def put(df: DataFrame, table: str, *by: str, then: tuple[str, ...] = ()) -> DataFrame:
        out = df.repartition(buckets, *by).write.option("path", f"{shared_root(spark)}/{name}_{table}")
        out.bucketBy(buckets, *by).sortBy(*by, *then).saveAsTable(f"{name}_{table}")
        return spark.table(f"{name}_{table}")

    nodes = put(g.nodes, "nodes", "node_id")
    edges = put(g.edges, "edges", "dst", then=("src",))
    deg = put(degrees(nodes, edges), "degrees", "node_id")
    hubs = deg.where(F.col("in_degree") > HUB_EDGES).limit(1).count() > 0
    adj = with_positions(edges, hubs)
    own = deg.select(F.col("node_id").alias("src"), F.col("in_degree").alias("src_deg"))
    put(adj.join(own, "src").select("dst", "pos", "src", "deg", "src_deg"), "lists", "dst", "pos")
    return name, g.num_nodes, hubs


def forget(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Drop the written tables of one folder's graph, or of all of this application's."""
    from ..plans.storage import delete

    app = spark.sparkContext.applicationId
    for key in [k for k in _kept if k[0] == app and sf_dir in (None, k[1])]:
        name = _kept.pop(key)[0]
        for table in ("nodes", "edges", "degrees", "lists"):
            where = spark.sql(f"DESCRIBE FORMATTED {name}_{table}").where("col_name = 'Location'").first()["data_type"]
            spark.sql(f"DROP TABLE {name}_{table}")
            delete(spark, where)


def train_set(graph: Graph) -> DataFrame:
    return graph.splits.where("split = 'train'").select("node_id")


def trail(spark: SparkSession, sf_dir: str) -> Graph:
    """Each user's events as a chain from one event to the next."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = read(spark, sf_dir, "events").select(F.col("event_id").cast("long"), "user_id", "ts")
    edges = events.select(F.lag("event_id").over(w).alias("src"), F.col("event_id").alias("dst")).where("src is not null")
    nodes = events.select(F.col("event_id").alias("node_id"))
    return Graph(nodes, edges, nodes.limit(0).withColumn("split", F.lit("")), events.count())


def access_log(spark: SparkSession, sf_dir: str, batch: int = 100, steps: int = 20) -> DataFrame:
    """access(batch_key, epoch, step, node_id): the users that each run of `batch` events touches, once per batch."""
    key = F.floor(F.col("event_id") / batch).cast("long")
    rows = read(spark, sf_dir, "events").select(key.alias("batch_key"), F.col("user_id").cast("long").alias("node_id")).distinct()
    return rows.select("batch_key", F.floor(F.col("batch_key") / steps).cast("long").alias("epoch"), (F.col("batch_key") % steps).alias("step"), "node_id")
