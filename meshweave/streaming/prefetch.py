"""The dynamic cache on a stream: seeds are sampled as they come, and each batch's inputs wait for what the batch before prefetched.

Two queries in a row. `sample_stream` samples each micro-batch of seeds against the written graph, with
the operators of the batch form, and appends what every batch reads and what it loads ahead.
`decide_stream` holds both in state, by (batch, bucket of nodes), until the watermark reaches the batch's
time; then a timer tells hits from misses and the state goes. Draws are functions of (batch, layer, node), so
batches may come in any order and in parts, as long as none is later than the watermark allows.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..operators.blocks import prefetch_set, sample_layers
from ..operators.gather import gather
from ..plans import storage

#: Seeds of a stream, of times after 1970 began (a watermark starts there); rows without batch_key are heartbeats, which only move the time on.
SEEDS = "batch_key long, node_id long, pos long, ts timestamp"
TOUCHED = "batch_key long, ts timestamp, node_id long, near boolean"
HEARTBEAT = -1
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def touched(seeds: DataFrame, edges: DataFrame, hops: Sequence[Callable[[DataFrame, int], DataFrame]], expand: bool = True) -> DataFrame:
    """(batch_key, ts, node_id, near): each batch's inputs (near false), and for the batch after it what it loads ahead.

    expand false tells the nodes whose lists are loaded ahead instead, for decide_stream to look them up in the edges:
    a batch's lists have many times the rows of the batch.

    seeds is SEEDS of any number of whole or partial batches. Near rows bear the key of the batch that
    they serve and the time of the one that loads them. Heartbeats pass with neither node nor key; seeds
    without a node and rows without a time are left out.
    """
    seeds = seeds.where("ts is not null")
    own = seeds.where("batch_key is not null and node_id is not null")
    _, reached = sample_layers(own.select("batch_key", "node_id", "pos"), list(hops))
    time = own.groupBy("batch_key").agg(F.max("ts").alias("ts"))
    ahead = reached.where(F.col("reached") < len(hops)).select("batch_key", "node_id")
    ahead = prefetch_set(edges, ahead) if expand else ahead
    read = reached.join(time, "batch_key").select("batch_key", "ts", "node_id", F.lit(False).alias("near"))
    near = ahead.join(time, "batch_key").select((F.col("batch_key") + 1).alias("batch_key"), "ts", "node_id", F.lit(True).alias("near"))
    beats = seeds.where("batch_key is null").select("batch_key", "ts", F.lit(None).cast("long").alias("node_id"), F.lit(False).alias("near"))
    return read.unionByName(near).unionByName(beats)


def sample_stream(seeds: DataFrame, edges: DataFrame, hops: Sequence[Callable[[DataFrame, int], DataFrame]], out: str, state: str, expand: bool = True) -> None:
    """Sample all seeds there, a folder a micro-batch; one that is run again after a failure overwrites its own folder. expand as in touched.

    What a micro-batch wrote on its way is deleted after it, so a stream leaves only its results.
    """

    def put(part: DataFrame, number: int) -> None:
        since = storage.mark()
        touched(part, edges, hops, *(() if expand else (False,))).write.mode("overwrite").parquet(f"{out}/trigger={number}")
        storage.clear(part.sparkSession, since)

    seeds.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


class Decide(StatefulProcessor):
    """State of a (batch, bucket): nodes with a mark for those loaded ahead, and the time at which inputs are due.

    Inputs are due when the watermark passes their batch's time: by then all that is not late is there, the
    batch before included. Nodes loaded ahead for a batch that has not come are kept for keep_ms.
    told: what is due is given out with its marks, instead of hits.
    """

    def __init__(self, keep_ms: int, told: bool = False):
        self.keep_ms, self.told = keep_ms, told

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.nodes = handle.getListState("nodes", StructType([StructField("node_ids", BinaryType()), StructField("near", BinaryType())]))
        self.due = handle.getValueState("due", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] != HEARTBEAT:
            got = pd.concat(list(rows)).drop_duplicates()
            for near, part in got.groupby("near"):
                at = int(part["at"].max())
                if near:
                    self.handle.registerTimer(at + self.keep_ms)
                else:
                    self.due.update((at,))
                    self.handle.registerTimer(at)
            pairs = got[["node_id", "near"]].drop_duplicates()
            self.nodes.appendList([(pairs["node_id"].to_numpy(np.int64).tobytes(), pairs["near"].to_numpy(bool).tobytes())])
        yield pd.DataFrame({"batch_key": [], "node_id": [], "near" if self.told else "is_hit": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.due.get() if self.due.exists() else None
        ids = np.zeros(0, np.int64)
        hit = np.zeros(0, bool)
        if due is None:
            self.nodes.clear()
        elif due[0] <= expiredTimerInfo.getExpiryTimeInMs():
            parts = list(self.nodes.get())
            held, near = (np.frombuffer(b"".join(bytes(p[i]) for p in parts), kind) for i, kind in enumerate((np.int64, bool)))
            ids, ahead = np.unique(held[~near]), np.unique(held[near])
            hit = np.isin(ids, ahead)
            if self.told:
                ids, hit = np.concatenate([ids, ahead]), np.arange(len(ids) + len(ahead)) >= len(ids)
            self.nodes.clear()
            self.due.clear()
        yield pd.DataFrame({"batch_key": np.full(len(ids), int(key[0])), "node_id": ids, "near" if self.told else "is_hit": hit})

    def close(self) -> None:
        pass


def decide(rows: DataFrame, late: str = "1 minute", keep: str = "1 hour", buckets: int = 16, told: bool = False) -> DataFrame:
    """A stream of (batch_key, node_id, is_hit) from a stream of TOUCHED rows; needs the RocksDB state store.

    Rows later than the watermark allows are dropped: late inputs get no answer, and inputs whose
    nodes were loaded too late, or more than keep before, are misses. Rows that come again change nothing.
    told gives (batch_key, node_id, near) instead: the inputs that are due, and with them the nodes marked as near.
    """
    whole = rows.fillna(HEARTBEAT, ["batch_key", "node_id"])  # a null among the keys would make them floats, which are no keys
    timed = whole.withColumn("at", F.unix_millis("ts")).withColumn("bucket", F.pmod(F.hash("node_id"), F.lit(buckets))).withWatermark("ts", late)
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    return timed.groupBy("batch_key", "bucket").transformWithStateInPandas(Decide(keep_ms, told), f"batch_key long, node_id long, {'near' if told else 'is_hit'} boolean", "Append", "EventTime")


@contextlib.contextmanager
def rocks_store(spark: SparkSession):
    """The state store that timers need, for queries started within; the session's own setting comes back."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def decide_stream(spark: SparkSession, folder: str, nodes: DataFrame, out: str, state: str, *cols: str, files_per_trigger: int = 64, edges: DataFrame | None = None, **options) -> DataFrame:
    """Decide all that sample_stream put into folder, with the named columns of nodes; the result is also the table at out.

    Both queries go on from their checkpoints, so calling them in turn as seeds arrive is one stream.
    edges are needed where sample_stream did not expand what is loaded ahead. State then holds a batch's own nodes
    only, a batch in one place, and lists are looked up once it is due, for its inputs alone.
    """
    source = spark.readStream.schema(TOUCHED).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    found = decide(source, **options) if edges is None else decide(source, **options | {"buckets": 1, "told": True})
    shape = nodes.select(F.lit(0).cast("long").alias("batch_key"), F.lit(0).cast("long").alias("node_id"), F.lit(True).alias("is_hit"), *cols).schema

    def put(part: DataFrame, number: int) -> None:
        since = storage.mark()
        due = storage.materialise(part, "due")
        inputs = due.where("not near").select("batch_key", "node_id")
        hits = prefetch_set(edges, due.where("near").select("batch_key", "node_id"), inputs)
        flags = inputs.join(hits.withColumn("is_hit", F.lit(True)), ["batch_key", "node_id"], "left").withColumn("is_hit", F.coalesce("is_hit", F.lit(False)))
        gather(nodes, flags, *cols).select("batch_key", "node_id", "is_hit", *cols).write.mode("overwrite").parquet(f"{out}/trigger={number}")
        storage.clear(spark, since)

    if cols and edges is None:
        found = found.join(nodes.select("node_id", *cols), "node_id", "left").select("batch_key", "node_id", "is_hit", *cols)
    with rocks_store(spark):
        if edges is None:
            query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        else:
            query = found.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(shape).parquet(out).select("batch_key", "node_id", "is_hit", *cols)
