"""Streams of events: micro-batches of seeds, windowed access counts, and state from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files; the rate limit is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _timed(events: DataFrame, late: str) -> tuple[DataFrame, str]:
    """Events with a watermark, and the type their times go back to: watermarks need zoned times."""
    kind = events.schema["ts"].dataType.simpleString()
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), kind


def windowed_access(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Accesses of each node per tumbling window; rows later than the watermark are dropped."""
    timed, kind = _timed(events, late)
    counted = timed.groupBy(F.window("ts", width), "user_id").agg(F.count("*").alias("freq"))
    return counted.select(F.col("window.start").cast(kind).alias("start"), F.col("user_id").cast("long").alias("node_id"), "freq")


def session_access(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Accesses of each node per session: a gap without events ends one."""
    timed, kind = _timed(events, late)
    counted = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("freq"))
    return counted.select(F.col("session_window.start").cast(kind).alias("start"), F.col("session_window.end").cast(kind).alias("end"), F.col("user_id").cast("long").alias("node_id"), "freq")


def latest_counts(spark: SparkSession, folder: str, schema, out: str, state: str, late: str = "1 hour", files_per_trigger: int = 1) -> DataFrame:
    """windowed_access of a folder's files, one a micro-batch, in update mode; returns the last count of each window.

    Each micro-batch appends the counts it changed under its number, so a batch that is run again
    after a failure gives the same rows, and the newest of a window's rows is its count.
    """

    def put(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = windowed_access(read_events(spark, folder, schema, files_per_trigger), late=late)
    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).groupBy("start", "node_id").agg(F.max_by("freq", "batch").alias("freq"))
    return rows.select("start", "node_id", "freq")


def repeats_across_batches(access: DataFrame) -> DataFrame:
    """(batch_key, node_id, again): whether the batch before had the node; state per node is its last batch key.

    access is (batch_key, node_id); rows of one node may come in any order within a micro-batch.
    """

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        keys = sorted({int(k) for p in parts for k in p["batch_key"]})
        out = []
        for k in keys:
            out.append((k, int(key[0]), last is not None and last == k - 1))
            last = k
        state.update((last,))
        yield pd.DataFrame(out, columns=["batch_key", "node_id", "again"])

    return access.groupBy("node_id").applyInPandasWithState(step, "batch_key long, node_id long, again boolean", "last long", "append", GroupStateTimeout.NoTimeout)
