"""Epoch shuffles, batches and their assignment to workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rand import draw
from ..functions.ranks import rank_by_draw


def num_steps(n: int, batch_size: int, drop_last: bool = False) -> int:
    return n // batch_size if drop_last else -(-n // batch_size)


def make_batches(ids: DataFrame, epochs: int, batch_size: int, seed: int, drop_last: bool = False) -> DataFrame:
    """batches(batch_key, epoch, step, pos, node_id): every epoch in its own random order, cut into batches."""
    steps = num_steps(ids.count(), batch_size, drop_last)
    rows = ids.select("node_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))).alias("epoch"))
    ranked = rank_by_draw(rows, draw(seed, F.col("epoch"), F.col("node_id")), "node_id", by=["epoch"])
    step = F.floor(F.col("rank") / batch_size).cast("long")
    cut = ranked.select("epoch", step.alias("step"), (F.col("rank") % batch_size).alias("pos"), "node_id").where(F.col("step") < steps)
    return cut.select((F.col("epoch") * steps + F.col("step")).alias("batch_key"), "epoch", "step", "pos", "node_id")


def aligned_worker(step: Column, workers: int) -> Column:
    """Round robin: step, step + workers, ... of one worker."""
    return F.pmod(step, F.lit(workers))


def split_steps(steps: int, workers: int) -> list[tuple[int, int]]:
    """Contiguous steps of each sampling worker; the last takes the remainder."""
    each = steps // workers
    return [(w * each, steps if w == workers - 1 else (w + 1) * each) for w in range(workers)]


def sampler_worker(step: Column, steps: int, workers: int) -> Column:
    each = max(1, steps // workers)
    return F.least(F.floor(step / each).cast("long"), F.lit(workers - 1))


def needed_steps(steps: int, workers: int) -> int:
    """Steps of every round-robin worker when all run equally many."""
    return -(-steps // workers)


def step_shares(rows: DataFrame, workers: int, steps: str = "steps") -> DataFrame:
    """Each row's steps as split_steps and needed_steps give them: a row a worker, with first_step, end_step and needed."""
    each = F.floor((F.col(steps) - F.pmod(F.col(steps), F.lit(workers))) / workers).cast("long")
    out = rows.withColumn("worker", F.explode(F.sequence(F.lit(0), F.lit(workers - 1))))
    last = F.col("worker") == workers - 1
    return out.withColumns({"first_step": F.col("worker") * each, "end_step": F.when(last, F.col(steps)).otherwise((F.col("worker") + 1) * each), "needed": F.ceil(F.col(steps) / workers).cast("long")})
