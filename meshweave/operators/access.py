"""Node-access analytics over access(batch_key, epoch, step, node_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import global_rank, rank_by_value


def access_counts(access: DataFrame) -> DataFrame:
    return access.groupBy("node_id").agg(F.count("*").alias("freq"))


def step_similarity(access: DataFrame) -> DataFrame:
    """Per batch: nodes, and how many of them the batch before had too."""
    before = access.select((F.col("batch_key") + 1).alias("batch_key"), "node_id", F.lit(1).alias("again"))
    both = access.select("batch_key", "node_id").join(before, ["batch_key", "node_id"], "left")
    return both.groupBy("batch_key").agg(F.count("*").alias("num_node"), F.count("again").alias("similar"))


def epoch_similarity(access: DataFrame, num_nodes: int, top: float = 0.1) -> DataFrame:
    """Per epoch: shared mass of both epochs' most accessed tenth, percent of this epoch's."""
    freq = access.groupBy("epoch", "node_id").agg(F.count("*").alias("freq"))
    ranked = global_rank(freq, [F.col("freq").desc(), F.col("node_id").desc()], by=["epoch"])
    hot = ranked.where(F.col("rank") < num_nodes * top).select("epoch", "node_id", "freq")
    before = hot.select((F.col("epoch") + 1).alias("epoch"), "node_id", F.col("freq").alias("old"))
    joined = hot.join(before, ["epoch", "node_id"], "left")
    shared = F.sum(F.least("freq", F.coalesce("old", F.lit(0))))
    return joined.groupBy("epoch").agg(F.round(shared * 100.0 / F.sum("freq"), 6).alias("similarity"))


def mean_similarity(per_epoch: DataFrame) -> DataFrame:
    return per_epoch.where("epoch >= 1").agg(F.round(F.avg("similarity"), 6).alias("mean_similarity"))


def access_report(access: DataFrame, deg: DataFrame) -> DataFrame:
    """(place, node_id, freq, in_degree, out_degree) of accessed nodes, most accessed first."""
    ranked = rank_by_value(access_counts(access), "freq", "node_id", "place")
    return ranked.join(deg, "node_id", "left").select("place", "node_id", "freq", "in_degree", "out_degree")


def frequency_table(access: DataFrame, deg: DataFrame) -> DataFrame:
    """Per access count, highest first: nodes, accesses, shares, running shares and degree ranges."""
    per = access_counts(access).join(deg, "node_id", "left").groupBy("freq").agg(
        F.count("*").alias("num_node"), F.sum("freq").alias("num_access"),
        F.min("in_degree").alias("min_in"), F.round(F.avg("in_degree"), 6).alias("avg_in"), F.max("in_degree").alias("max_in"),
        F.min("out_degree").alias("min_out"), F.round(F.avg("out_degree"), 6).alias("avg_out"), F.max("out_degree").alias("max_out"),
    )
    every, upto = Window.partitionBy(), Window.orderBy(F.col("freq").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name in ("node", "access"):
        n = F.col(f"num_{name}")
        per = per.withColumn(f"{name}_pct", F.round(n * 100.0 / F.sum(n).over(every), 6)).withColumn(f"cum_{name}_pct", F.round(F.sum(n).over(upto) * 100.0 / F.sum(n).over(every), 6))
    return per


def step_ratio(per_step: DataFrame) -> DataFrame:
    return per_step.select("batch_key", F.round(F.try_divide("similar", "num_node"), 6).alias("ratio"))


def hit_curve(freq: DataFrame, num_nodes: int) -> DataFrame:
    """(percent, hit): share of accesses that the best floor(percent * N / 100) nodes take, for 0..100.

    freq is (node_id, freq); nodes without a row count 0. Sums by whole frequencies first, so only
    one row per frequency and the few points inside one are summed in order. The 101 points go to
    the frequencies, however many there are.
    """
    per = freq.where("freq > 0").groupBy("freq").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.col("freq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    mass = F.col("n") * F.col("freq")
    steps = per.select("freq", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("nodes_before"), F.coalesce(F.sum(mass).over(before), F.lit(0)).alias("mass_before"), F.sum(mass).over(Window.partitionBy()).alias("total"))
    points = freq.sparkSession.range(101).select(F.col("id").alias("percent"), F.floor(F.col("id") * num_nodes / 100).cast("long").alias("k"))
    met = steps.join(F.broadcast(points), (F.col("k") > F.col("nodes_before")) & (F.col("k") <= F.col("nodes_before") + F.col("n")))
    met = points.join(met.drop("k"), "percent", "left")
    inside = F.col("mass_before") + (F.col("k") - F.col("nodes_before")) * F.col("freq")
    hit = F.when(F.col("k") == 0, 0.0).when(F.col("total").isNull(), 1.0).otherwise(inside / F.col("total"))
    return met.select("percent", F.round(hit, 6).alias("hit"))


def presample_report(ranking: DataFrame, access: DataFrame) -> DataFrame:
    """(rank, node_id, presampled, real): frequencies of a presampling and of a real run, by rank."""
    real = access_counts(access).withColumnRenamed("freq", "real")
    return ranking.join(real, "node_id", "left").select("rank", "node_id", F.col("freq").alias("presampled"), F.coalesce("real", F.lit(0).cast("long")).alias("real"))


def prefix_and_last(rows: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """The last k rows of each group in the given order, with how many rows of the group come before each."""
    w = Window.partitionBy(by)
    placed = rows.withColumn("before_", F.row_number().over(w.orderBy(order)).cast("long") - 1)
    return placed.withColumn("__last", F.row_number().over(w.orderBy(F.col(order).desc()))).where(F.col("__last") <= k).drop("__last")
