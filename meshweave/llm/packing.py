"""Best-fit-decreasing packing of token pieces into sequences of a fixed capacity.

Documents become pieces (only the too long are cut) in one pass that keeps lengths and checksums,
not ids. Pieces are dealt by hash into bounded shards; each shard packs its pieces in decreasing
order, a segment tree over remaining capacities naming the tightest open bin in logarithmic time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fast_encoder, stash, tokenizer_file

CAPACITY = 2048
SHARD_PIECES = 32768
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class CapacityTree:
    """Open bins by remaining capacity; `tightest(n)` finds the smallest capacity >= n that has one."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, capacity: int, which: int) -> None:
        self.bins[capacity].append(which)
        at = capacity + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, capacity: int) -> int:
        at = capacity + self.size
        while at:
            self.count[at] -= 1
            at >>= 1
        return self.bins[capacity].pop()

    def tightest(self, need: int) -> int:
        """-1 if no open bin has room."""
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1:  # up to the first right sibling with a bin, then down its leftmost path
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at + (not self.count[2 * at])
                return at - self.size
            at >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, in the given order; lengths lie in 1..capacity."""
    tree, rooms = CapacityTree(capacity), 0
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[i]
        room = tree.tightest(n)
        if room < 0:
            which, room, rooms = rooms, capacity, rooms + 1
        else:
            which = tree.take(room)
        bins[i], offsets[i] = which, capacity - room
        if room > n:
            tree.add(room - n, which)
    return bins, offsets


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Pieces of at most `capacity` tokens; a longer document's first piece takes what whole ones leave."""
    path = path or tokenizer_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = fast_encoder(path), np.array([end_id], "<u4")
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                n = len(ids)
                cut = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                rows += [(i, k, a, z - a, zlib.crc32(ids[a:z])) for k, (a, z) in enumerate(zip(cut, cut[1:]))]
            cols = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES, path: str | None = None) -> DataFrame:
    """One row per piece with the sequence it went to and its place there.

    Null and empty texts are one token, the end id. Repeated rows are packed each by itself, null
    ids stay null, an empty table packs to no rows. A shard's bins lie within one sequence_id range.
    """
    made = stash(pieces(docs, id_col, text_col, capacity, end_id, path), "pieces")
    shards = max(1, -(-made.count() // shard_pieces))

    def run(key, rows):
        bins, offsets = best_fit_decreasing(rows.column("length").to_pylist(), capacity)
        base = key[0].as_py() << 32
        return rows.drop_columns(["shard"]).append_column("sequence_id", pa.array(np.array(bins, np.int64) + base)).append_column("offset", pa.array(offsets, pa.int64()))

    # dealt by place in the written table: rows that repeat, ids and all, do not meet in one shard
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))
    return made.withColumn("shard", shard).groupBy("shard").applyInArrow(run, PACKED)
