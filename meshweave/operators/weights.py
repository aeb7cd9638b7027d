"""Edge weights and the tables that weighted samplers read."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import u32
from ..functions.ranks import running_sums
from ..plans.storage import materialise
from .temporal import as_of_join


def edge_weights(edges: DataFrame, deg: DataFrame, policy: str, seed: int = 0) -> DataFrame:
    """edges with column w. Policies: default, inverse_both_degree_random, inverse_source_degree, source_suffix."""
    out = deg.select(F.col("node_id").alias("src"), F.col("out_degree").alias("so"))
    if policy == "default":
        return edges.withColumn("w", (u32(seed, "w", F.col("src"), F.col("dst")) % 10 + 1).cast("double"))
    with_out = edges.join(out, "src")
    if policy == "inverse_source_degree":
        return with_out.withColumn("w", F.lit(1.0) / F.col("so")).drop("so")
    if policy == "source_suffix":
        return with_out.withColumn("w", F.when(F.col("so") < 10, 100.0).otherwise(1.0)).drop("so")
    if policy == "inverse_both_degree_random":
        ins = deg.select(F.col("node_id").alias("dst"), F.col("in_degree").alias("di"))
        top = F.greatest("so", "di")
        return with_out.join(ins, "dst").withColumn("w", F.lit(1.0) / (u32(seed, "w", F.col("src"), F.col("dst")) % top + 1)).drop("so", "di")
    raise ValueError(f"no weight policy {policy}")


def prefix_table(weighted: DataFrame, hubs: bool = False) -> DataFrame:
    """adj(dst, pos, src, w, prefix, deg): running weight sums in list order, not normalised; hubs as in build.with_positions."""
    if hubs:
        rows = running_sums(weighted.select("dst", "src", "w"), "dst", [F.col("src").asc()], {"deg": "pos"}, pos=F.lit(1).cast("long"), prefix=F.col("w"))
        return rows.select("dst", (F.col("pos") - 1).alias("pos"), "src", "w", "prefix", "deg")
    w = Window.partitionBy("dst")
    upto = w.orderBy("src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return weighted.select("dst", (F.row_number().over(w.orderBy("src")).cast("long") - 1).alias("pos"), "src", "w", F.sum("w").over(upto).alias("prefix"), F.count("*").over(w).alias("deg"))


def alias_rows(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keep-probability of each slot and the slot taken otherwise, for one small list; see alias_table."""
    n, total = len(weights), float(np.sum(weights))
    spare = np.asarray(weights, np.float64) * n - total
    light, heavy = np.flatnonzero(spare < 0), np.flatnonzero(spare >= 0)
    keep, other = np.ones(n), np.arange(n)
    need, give = np.cumsum(-spare[light]), np.cumsum(spare[heavy])
    by = np.searchsorted(give, np.concatenate(([0.0], need))[:-1], side="right")
    served = by < len(heavy)
    keep[light[served]] = (spare[light[served]] + total) / total
    other[light[served]] = heavy[by[served]]
    after = np.searchsorted(need, give, side="left")
    for j in range(len(heavy) - 1):
        if after[j] < len(light) and need[after[j]] > give[j]:
            keep[heavy[j]], other[heavy[j]] = 1 + (give[j] - need[after[j]]) / total, heavy[j + 1]
    return keep, other


def _alias_of_hubs(adj: DataFrame) -> DataFrame:
    """alias_table where lists may be too long for a task: running sums by range, lookups as joins as of a sum."""
    rows = adj.select("dst", "pos", "src", F.col("w").cast("double").alias("w"), "deg")
    rows = materialise(rows.join(rows.groupBy("dst").agg(F.sum("w").alias("total")), "dst").withColumn("spare", F.col("w") * F.col("deg") - F.col("total")), "alias-spare")
    light = F.col("spare") < 0
    rows = materialise(running_sums(rows, "dst", [F.col("pos").asc()], need=F.when(light, -F.col("spare")).otherwise(0.0), give=F.when(light, 0.0).otherwise(F.col("spare"))), "alias-sums")
    poor, rich = rows.where(light), rows.where(~light)
    down = lambda df, c, *more: df.select("dst", (-F.col(c)).alias("at"), "pos", *more)
    # a light slot's need before it; the first heavy one whose sum passes that
    before = as_of_join(poor.withColumn("at", F.col("pos")), poor.select("dst", F.col("pos").alias("at"), F.col("need").alias("before")), "dst", "at", "before", strict=True)
    asks = before.withColumn("at", -F.coalesce("before", F.lit(0.0)))
    served = as_of_join(asks, down(rich, "give", F.col("src").alias("giver")), "dst", "at", "giver", tie=-F.col("pos"), strict=True)
    served = served.select("dst", "pos", "src", "w", "deg", F.when(F.col("giver").isNotNull(), (F.col("spare") + F.col("total")) / F.col("total")).otherwise(1.0).alias("prob"), F.coalesce("giver", "src").alias("alias"))
    # the first need that a heavy slot's sum does not exceed, and the next heavy slot
    asks = rich.withColumn("at", -F.col("give"))
    spent = as_of_join(asks, down(poor, "need", F.col("need").alias("reached")), "dst", "at", "reached", tie=-F.col("pos"))
    spent = as_of_join(spent.withColumn("at", -F.col("pos")), down(rich, "pos", F.col("src").alias("next")), "dst", "at", "next", strict=True)
    drained = (F.col("reached") > F.col("give")) & F.col("next").isNotNull()
    prob = F.when(drained, F.lit(1.0) + (F.col("give") - F.col("reached")) / F.col("total")).otherwise(1.0)
    return served.unionByName(spent.select("dst", "pos", "src", "w", "deg", prob.alias("prob"), F.when(drained, F.col("next")).otherwise(F.col("src")).alias("alias")))


def alias_table(adj: DataFrame, hubs: bool = False) -> DataFrame:
    """adj(dst, pos, src, w, deg) with prob and alias (a node), from running sums alone.

    With spare = n * w - sum(w), light slots (spare < 0) are filled in list order by heavy ones in list
    order. A light slot takes the first heavy one whose running spare passes the running need before
    it. A heavy slot that has given more than it had is filled by the next heavy one. Both are
    found by sorting the two running sums of a list into each other; nothing is held per list. hubs is for
    lists too long for one task, whose sums are then swept range by range.
    """
    if hubs:
        return _alias_of_hubs(adj)
    rows = adj.select("dst", "pos", "src", F.col("w").cast("double").alias("w"), "deg")
    own = Window.partitionBy("dst")
    upto = own.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = own.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("w").over(whole)).withColumn("spare", F.col("w") * F.col("deg") - F.col("total"))
    light = F.col("spare") < 0
    rows = rows.withColumn("need", F.sum(F.when(light, -F.col("spare")).otherwise(0.0)).over(upto)).withColumn("give", F.sum(F.when(light, 0.0).otherwise(F.col("spare"))).over(upto))
    before = F.coalesce(F.last(F.when(light, F.col("need")), ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("before", before)
    # from the highest sum down: a light slot looks for the last heavy one above `before`, a heavy one for the last need not below `give`
    rows = rows.withColumn("heavy", (~light).cast("int"))
    first = own.orderBy(F.when(light, F.col("before")).otherwise(F.col("give")).desc(), "heavy", F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("giver", F.last(F.when(~light, F.col("src")), ignorenulls=True).over(first))
    second = own.orderBy(F.when(light, F.col("need")).otherwise(F.col("give")).desc(), "heavy", F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("reached", F.last(F.when(light, F.col("need")), ignorenulls=True).over(second))
    down = own.orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("next", F.last(F.when(~light, F.col("src")), ignorenulls=True).over(down))
    drained = ~light & (F.col("reached") > F.col("give")) & F.col("next").isNotNull()
    served = light & F.col("giver").isNotNull()
    prob = F.when(served, (F.col("spare") + F.col("total")) / F.col("total")).when(drained, F.lit(1.0) + (F.col("give") - F.col("reached")) / F.col("total")).otherwise(1.0)
    alias = F.when(served, F.col("giver")).when(drained, F.col("next")).otherwise(F.col("src"))
    return rows.select("dst", "pos", "src", "w", "deg", prob.alias("prob"), alias.alias("alias"))
