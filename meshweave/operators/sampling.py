"""Single-hop neighbour samplers and random walks; `batch_key` lets many batches run in one job.

Frontiers are (batch_key, node_id); results are (batch_key, dst, src), dst being the node sampled for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import draw, u32, uniform
from ..plans.storage import materialise
from .temporal import as_of_join


def _meet(adj: DataFrame, frontier: DataFrame) -> DataFrame:
    return frontier.select("batch_key", F.col("node_id").alias("dst")).join(adj, "dst")


def _first(rows: DataFrame, key: Column, fanout: int) -> DataFrame:
    """The fanout lowest keys per (batch, node): partial limits run before the shuffle's sort."""
    place = F.row_number().over(Window.partitionBy("batch_key", "dst").orderBy(key, "src"))
    return rows.withColumn("__place", place).where(F.col("__place") <= fanout).select("batch_key", "dst", "src")


def _copies(rows: DataFrame, simple: bool) -> tuple[DataFrame, tuple[Column, ...]]:
    """rows with the number of each copy of an edge (0 for the first), and the keys that tell copies apart.

    A first copy draws by its edge alone, so a graph without copies draws the same whether it is
    known to be simple or not.
    """
    if simple:
        return rows, ()
    copy = F.row_number().over(Window.partitionBy("batch_key", "dst", "src").orderBy(F.lit(0))) - 1
    return rows.withColumn("__copy", copy), (F.when(F.col("__copy") > 0, F.col("__copy")),)


def khop(edges: DataFrame, frontier: DataFrame, fanout: int, seed: int, layer: int = 0, simple: bool = False) -> DataFrame:
    """Uniform without replacement; nodes of degree up to fanout give all their neighbours.

    Copies of an edge are positions of their own; simple says that there are none, which spares
    numbering them. Every position of a list is drawn a digest; khop_places draws only fanout.
    """
    met, more = _copies(_meet(edges.select("dst", "src"), frontier), simple)
    return _first(met, draw(seed, F.col("batch_key"), layer, F.col("dst"), F.col("src"), *more), fanout)


def _lengths(adj: DataFrame, degrees: DataFrame | None) -> DataFrame:
    """(dst, deg) of every list: from degrees(node_id, in_degree) where they are at hand, a row a node, else from the lists' first places."""
    if degrees is None:
        return adj.select("dst", "deg").where("pos = 0")
    return degrees.select(F.col("node_id").alias("dst"), F.col("in_degree").alias("deg"))


def khop_places(adj: DataFrame, frontier: DataFrame, fanout: int, seed: int, layer: int = 0, degrees: DataFrame | None = None) -> DataFrame:
    """Uniform without replacement over the positions of adj(dst, pos, src, deg), by fanout draws whatever the degree.

    The positions are a uniform subset by Floyd's rule: for k = deg - fanout .. deg - 1, a draw from
    0..k is taken, or k itself if the draw is already in. Only these positions meet the lists: where those
    lie in buckets by (dst, pos), the draws alone are shuffled, and a hub's draws go to all of its buckets.
    """
    deg = _lengths(adj, degrees)
    start = F.greatest(F.col("deg") - fanout, F.lit(0).cast("long"))

    def add(taken, k):
        t = u32(seed, F.col("batch_key"), layer, F.col("dst"), k) % (k + 1)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, t), k).otherwise(t)))

    places = F.aggregate(F.sequence(start, F.col("deg") - 1), F.array().cast("array<bigint>"), add)
    drawn = _meet(deg, frontier).where("deg > 0").select("batch_key", "dst", F.explode(places).alias("pos"))
    drawn = materialise(drawn, "drawn")  # so that the join goes by the true number of draws
    return drawn.join(adj.select("dst", "pos", "src"), ["dst", "pos"]).select("batch_key", "dst", "src")


def khop_replace(adj: DataFrame, frontier: DataFrame, fanout: int, seed: int, layer: int = 0, degrees: DataFrame | None = None) -> DataFrame:
    """Uniform with replacement: fanout draws of a position each, equal neighbours once."""
    draws = _meet(_lengths(adj, degrees).where("deg > 0"), frontier).select("batch_key", "dst", "deg", F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))).alias("turn"))
    draws = draws.select("batch_key", "dst", (u32(seed, F.col("batch_key"), layer, F.col("dst"), F.col("turn")) % F.col("deg")).alias("pos"))
    return draws.join(adj.select("dst", "pos", "src"), ["dst", "pos"]).select("batch_key", "dst", "src").distinct()


def khop_alias(table: DataFrame, frontier: DataFrame, fanout: int, seed: int, layer: int = 0) -> DataFrame:
    """Weighted with replacement by alias tables (dst, pos, src, deg, prob, alias)."""
    deg = table.select("dst", "deg").where("pos = 0")
    draws = _meet(deg, frontier).select("batch_key", "dst", "deg", F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))).alias("turn"))
    keys = (F.col("batch_key"), layer, F.col("dst"), F.col("turn"))
    draws = draws.select("batch_key", "dst", (u32(seed, "slot", *keys) % F.col("deg")).alias("pos"), uniform(seed, "keep", *keys).alias("u"))
    kept = F.when(F.col("u") < F.col("prob"), F.col("src")).otherwise(F.col("alias"))
    return draws.join(table.select("dst", "pos", "src", "prob", "alias"), ["dst", "pos"]).select("batch_key", "dst", kept.alias("src")).distinct()


def khop_prefix(table: DataFrame, frontier: DataFrame, fanout: int, seed: int, layer: int = 0, hubs: bool = False) -> DataFrame:
    """Weighted with replacement by running sums: each draw takes the first position whose sum reaches it.

    Draws are sorted into the running sums of their node, so a draw meets one position, however
    long the list, and lists of other nodes are left out before the sort. hubs is for lists too long for
    one task: lists and draws are then swept range by range.
    """
    top = table.where(F.col("pos") == F.col("deg") - 1).select("dst", F.col("prefix").alias("top"))
    draws = _meet(top, frontier).select("batch_key", "dst", "top", F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))).alias("turn"))
    x = uniform(seed, F.col("batch_key"), layer, F.col("dst"), F.col("turn")) * F.col("top")
    if hubs:
        asked = draws.select("batch_key", "dst", (-x).alias("at"))
        sums = table.join(draws.select("dst").distinct(), "dst", "left_semi").select("dst", (-F.col("prefix")).alias("at"), "pos", "src")
        return as_of_join(asked, sums, "dst", "at", "src", tie=-F.col("pos")).select("batch_key", "dst", "src").distinct()
    draws = draws.select("dst", x.alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("long").alias("src"), "batch_key")
    wanted = frontier.select(F.col("node_id").alias("dst")).distinct()
    sums = table.join(wanted, "dst", "left_semi").select("dst", F.col("prefix").alias("at"), F.lit(1).alias("kind"), "pos", "src", F.lit(None).cast("long").alias("batch_key"))
    # from the highest sum down, the last position before a draw is the first that reaches it
    down = Window.partitionBy("dst").orderBy(F.col("at").desc(), F.col("kind").desc(), F.col("pos").desc())
    found = F.last("src", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return draws.unionByName(sums).withColumn("found", found).where("kind = 0").select("batch_key", "dst", F.col("found").alias("src")).distinct()


def khop_weighted(weighted: DataFrame, frontier: DataFrame, fanout: int, seed: int, layer: int = 0, simple: bool = False) -> DataFrame:
    """Weighted without replacement: lowest exponential keys, the law of drawing until fanout are distinct.

    Copies of an edge are positions of their own; simple says that there are none.
    """
    met, more = _copies(_meet(weighted.select("dst", "src", "w"), frontier), simple)
    u = uniform(seed, F.col("batch_key"), layer, F.col("dst"), F.col("src"), *more)
    return _first(met, -F.ln(u) / F.col("w"), fanout)


def neighbours(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """All neighbours; duplicates stay."""
    return _meet(edges.select("src", "dst"), frontier).select("batch_key", "dst", "src")


def all_neighbour_frontier(edges: DataFrame, frontier: DataFrame, hops: int) -> DataFrame:
    """Distinct nodes within the given hops of a batch's seeds."""
    reached = frontier.select("batch_key", "node_id").distinct()
    for _ in range(hops):
        more = neighbours(edges, reached).select("batch_key", F.col("src").alias("node_id"))
        reached = materialise(reached.unionAll(more).distinct(), "reached")
    return reached


def random_walk(adj: DataFrame, frontier: DataFrame, length: int, restart: float, walks: int, seed: int) -> DataFrame:
    """visits(batch_key, seed_id, walk, step, node_id): uniform steps; a dead end or, after a visit, the restart chance ends a walk.

    A step joins each walk with one position of a list. Lists with src_deg, the neighbour's own
    degree, tell the next step's range too; without it the degree is looked up before each step.
    Steps are written to the shared folder, so each joins by the true number of walks left.
    """
    deg = adj.where("pos = 0").select(F.col("dst").alias("at"), "deg")
    known = "src_deg" in adj.columns
    lists = adj.select(F.col("dst").alias("at"), "pos", "src", *(["src_deg"] if known else []))
    now = frontier.select("batch_key", F.col("node_id").alias("seed_id"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"), F.col("node_id").alias("at"))
    now, visits = materialise(now.join(deg, "at") if known else now, "walk"), None
    for step in range(length):
        keys = (F.col("batch_key"), F.col("seed_id"), F.col("walk"), step)
        if not known:
            now = now.join(deg, "at")
        drawn = now.where("deg > 0").withColumn("pos", u32(seed, "step", *keys) % F.col("deg")).drop("deg")
        here = drawn.join(lists, ["at", "pos"]).select("batch_key", "seed_id", "walk", F.lit(step).alias("step"), F.col("src").alias("node_id"), *(["src_deg"] if known else []))
        here = materialise(here, "walk")
        visit = here.drop("src_deg")
        visits = visit if visits is None else visits.unionAll(visit)
        go_on = here.where(uniform(seed, "stop", *keys) >= restart)
        now = go_on.select("batch_key", "seed_id", "walk", F.col("node_id").alias("at"), *([F.col("src_deg").alias("deg")] if known else []))
    return visits


def visit_topk(visits: DataFrame, k: int) -> DataFrame:
    """(batch_key, dst, src, w): the k most visited nodes of each seed; ties to the smaller id."""
    counts = visits.groupBy("batch_key", "seed_id", "node_id").agg(F.count("*").alias("w"))
    place = F.row_number().over(Window.partitionBy("batch_key", "seed_id").orderBy(F.col("w").desc(), "node_id"))
    return counts.withColumn("__place", place).where(F.col("__place") <= k).select("batch_key", F.col("seed_id").alias("dst"), F.col("node_id").alias("src"), "w")
