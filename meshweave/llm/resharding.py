"""Resharding by minimum-cost flow: new shard capacities are met by the transfers that move the fewest bytes.

Each old shard's rows are put in order, the largest first, and numbered by running sums that cut a shard of
any size into ranges. Old shards and new capacities make a small flow network: rows that stay cost
nothing, rows that leave cost their bytes, and of a shard's rows the smallest leave. The solved flow
becomes block transfers (runs of a shard's order with their target), of which there are fewer than old
and new shards together, and rows find theirs by their number alone.
"""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import running_sums
from .common import column, stash

SHARDS = 24
#: Bytes that a document takes beside its text.
OVERHEAD = 8


@dataclasses.dataclass(frozen=True)
class Transfer:
    """Rows first .. first + rows - 1 of an old shard's order, which get the slots from slot on in the new shard."""

    old: int
    first: int
    rows: int
    shard: int
    slot: int


class Network:
    """A flow network with costs; flows of least cost by successive cheapest paths."""

    def __init__(self):
        self.to, self.left, self.cost, self.arcs = [], [], [], {}

    def arc(self, a, b, capacity: int, cost: int = 0) -> int:
        for here, there, room, price in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.arcs.setdefault(here, []).append(len(self.to))
            self.arcs.setdefault(there, [])
            self.to.append(there)
            self.left.append(room)
            self.cost.append(price)
        return len(self.to) - 2

    def _cheapest(self, source):
        far, by, changed = {source: 0}, {}, [source]
        while changed:
            nodes, changed = changed, []
            for a in nodes:
                for i in self.arcs.get(a, []):
                    b, price = self.to[i], far[a] + self.cost[i]
                    if self.left[i] and price < far.get(b, price + 1):
                        far[b], by[b] = price, i
                        changed.append(b)
        return by

    def solve(self, source, sink) -> int:
        """Send as much as fits, at the least cost; returns how much. An arc's flow is flow(arc) afterwards."""
        sent = 0
        while sink in (by := self._cheapest(source)):
            path, node = [], sink
            while node != source:
                path.append(by[node])
                node = self.to[by[node] ^ 1]
            room = min(self.left[i] for i in path)
            for i in path:
                self.left[i] -= room
                self.left[i ^ 1] += room
            sent += room
        return sent

    def flow(self, arc: int) -> int:
        return self.left[arc ^ 1]


def kept_rows(counts: dict[int, int], bounds: list[tuple[int, int]], edge: dict[int, int]) -> tuple[dict[int, int], list[int]]:
    """(rows that stay in each old shard, rows of each new shard) so that the fewest bytes move.

    counts are the rows of the old shards, bounds the least and most rows of the new ones; edge has
    the bytes of the row that old shard i would lose next when it keeps only its lower bound. Old
    shards beyond the new ones lose all. Ties keep rows in the shard of the smaller number, and
    free room goes to the shards of smaller numbers.
    """
    k, net, total = len(bounds) + len(counts) + 1, Network(), sum(counts.values())
    least = sum(low for low, _ in bounds)
    if least > total or sum(high for _, high in bounds) < total:
        raise ValueError(f"{total} rows cannot meet these capacities")
    stay, get = {}, []
    for i, n in sorted(counts.items()):
        low, high = bounds[i] if i < len(bounds) else (0, 0)
        net.arc("all", ("old", i), n)
        if i < len(bounds):
            stay[i] = net.arc(("old", i), ("new", i), min(n, high))
        net.arc(("old", i), "moving", max(0, n - high), 1)
        # what leaves though it might stay: one row where the bounds differ by one, else more than any row is worth
        price = edge.get(i, 0) if high - low <= 1 else sum(edge.values()) + 1
        net.arc(("old", i), "moving", min(n, high), (price + 1) * k**4 + (k - i) * k**2)
    # what the lower bounds leave over may go anywhere up to the upper ones; lower bounds come first
    net.arc("spare", "end", total - least)
    for j, (low, high) in enumerate(bounds):
        net.arc("moving", ("new", j), total)
        get.append((net.arc(("new", j), "end", low), net.arc(("new", j), "spare", high - low, j)))
    net.solve("all", "end")
    return {i: net.flow(a) for i, a in stay.items()}, [net.flow(a) + net.flow(b) for a, b in get]


def transfers(counts: dict[int, int], kept: dict[int, int], sizes: list[int]) -> list[Transfer]:
    """The blocks: first what stays, then what each shard loses, in order, to the shards with room, in order."""
    out = [Transfer(i, 0, n, i, 0) for i, n in sorted(kept.items()) if n]
    taken = {j: kept.get(j, 0) for j in range(len(sizes))}
    room = [j for j, n in enumerate(sizes) if n > taken[j]]
    for i, n in sorted(counts.items()):
        at = kept.get(i, 0)
        while at < n:
            j = room[0]
            rows = min(n - at, sizes[j] - taken[j])
            out.append(Transfer(i, at, rows, j, taken[j]))
            at, taken[j] = at + rows, taken[j] + rows
            if taken[j] == sizes[j]:
                room.pop(0)
    return out


def even(total: int, shards: int) -> list[tuple[int, int]]:
    """Bounds of row counts that are at most one apart."""
    return [(total // shards, -(-total // shards))] * shards


def hashed_shard(value: Column, shards: int = SHARDS) -> Column:
    """A layout by hash: the first 32 bits of the MD5 of a string, null as the empty one, modulo the shards."""
    return (F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % shards).cast("int")


def measured(docs: DataFrame, old: Column, *keep: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, old, row): what placing a document needs, from one reading of the texts; null texts count as empty."""
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    rows = docs.select(column(id_col).alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), old.cast("int").alias("old"), *keep)
    return stash(rows.withColumn("row", F.monotonically_increasing_id()), "reshard-rows")


def place(rows: DataFrame, capacities: list[tuple[int, int]] | int = SHARDS) -> tuple[DataFrame, list[Transfer]]:
    """(rows with shard and slot, the transfers); capacities: bounds of each new shard, or how many even ones.

    Rows are as measured() gives them, old shard numbers from 0. Within a shard the largest rows come first, ties by doc_id
    (nulls first), checksum and place in the input, so repeated rows have places of their own. Only counts by
    shard reach the driver. An empty table gives no rows and no transfers.
    """
    counts = {r["old"]: r["n"] for r in rows.groupBy("old").agg(F.count("*").alias("n")).collect()}
    bounds = even(sum(counts.values()), capacities) if isinstance(capacities, int) else capacities
    order = [F.col("size").desc(), F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("row").asc()]
    ranked = stash(running_sums(rows, "old", order, place=F.lit(1).cast("long")), "reshard-order")
    # the row that a shard loses beside those it must, if it gets its lower bound
    low = F.get(F.array(*[F.lit(b[0]).cast("long") for b in bounds]), F.col("old"))
    edge = ranked.where(F.col("place") == low + 1).groupBy("old").agg(F.max("size").alias("size"))
    kept, sizes = kept_rows(counts, bounds, {r["old"]: r["size"] for r in edge.collect()})
    moves = transfers(counts, kept, sizes)
    schema = "old int, first long, rows long, shard int, slot_from long"
    table = rows.sparkSession.createDataFrame([dataclasses.astuple(t) for t in moves], schema)
    # fewer transfers than old and new shards together, so their table is broadcast
    here = (F.col("place") > F.col("first")) & (F.col("place") <= F.col("first") + F.col("rows"))
    placed = ranked.join(F.broadcast(table), "old").where(here)
    return placed.withColumn("slot", F.col("slot_from") + F.col("place") - 1 - F.col("first")).drop("first", "rows", "slot_from", "place"), moves


def reshard(docs: DataFrame, old: Column, shards: int = SHARDS, **columns: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard) by the law 'rows': counts at most one apart.

    old is the number of the shard that holds a document now. Of all ways to reach such counts this moves
    the fewest bytes. Columns of docs beside the text and the id are read only by old. Null texts have the
    size of empty ones, null ids are ids like others.
    """
    placed, _ = place(measured(docs, old, **columns), shards)
    none = F.lit(None).cast("int")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", none.alias("grown_shard"), F.col("old").alias("old_shard"))


def rewrite(spark: SparkSession, folder: str, shards: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Bring a folder of shard=N/*.parquet to `shards` shards of even counts; (shard, path, rows, bytes, rewritten) of the result.

    Only shards that lose or get rows are written anew, to a folder of their own beside the old ones; the others keep
    their files, and nothing old is changed or deleted, so readers and a failed run lose nothing. A
    row is known by its file and its place there, so whole texts move once, and only for affected shards.
    Reading the paths returned gives exactly the rows of the folder.
    """
    docs = spark.read.option("basePath", folder).parquet(f"{folder}/shard=*")
    where = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__nth"))
    rows = measured(where, F.col("shard"), F.col("__file"), F.col("__nth"), text_col=text_col, id_col=id_col)
    placed, moves = place(rows, shards)
    lost = {t.old for t in moves if t.old != t.shard}
    touched = sorted({t.shard for t in moves if t.old != t.shard} | (lost & set(range(shards))))
    out = f"{folder}/moved-{uuid.uuid4().hex}"
    placed = placed.select("__file", "__nth", F.col("shard").alias("__shard"), "size")
    if touched:
        moving = placed.where(F.col("__shard").isin(touched)).drop("size")
        whole = where.drop("shard").join(moving, ["__file", "__nth"]).drop("__file", "__nth").withColumnRenamed("__shard", "shard")
        whole.repartition(4 * len(touched), "shard", F.pmod(F.xxhash64(column(id_col)), F.lit(4))).write.partitionBy("shard").parquet(out)
    path = F.when(F.col("shard").isin(touched), F.lit(out)).otherwise(F.lit(folder))
    sums = placed.groupBy(F.col("__shard").alias("shard")).agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    return sums.select("shard", F.concat(path, F.lit("/shard="), F.col("shard")).alias("path"), "rows", "bytes", F.col("shard").isin(touched).alias("rewritten"))
