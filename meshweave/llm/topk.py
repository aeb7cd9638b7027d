"""Exact top-k by inner product over a bit-sliced index.

Rows are dealt into bounded blocks. A block's index keeps, for each attribute, bitmaps of the
quantised value's bits (one bit per row). A query adds the slices, weighted by its own components,
with carry-save bitmap arithmetic; the k-th highest sum is found from the most significant slice of
the sums downward, and every row whose exact score could still be among the first k is scored
exactly. Query blocks meet all row blocks, each pair of blocks being a key of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, stash

SCALE = 64
K = 20
BITS = 6
ROW_BLOCK = 16384
QUERY_BLOCK = 2048


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): integer vectors; null ones and those with null or non-finite components are left out.

    So are vectors whose inner product with one of their own kind need not fit a long: those of
    dimension d with a component m, floored, of d * m * m >= 2**63 (for 64 dimensions, some 5.9
    million before scaling). All scores of the others are exact longs.
    """
    x = column(vec_col).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    top = F.array_max(F.transform(x, lambda c: F.abs(c) * scale + 1))
    fits = F.coalesce(top * top * F.size(x) < float(2**63), F.lit(True))  # an empty vector has no largest component
    whole = vectors.where(column(vec_col).isNotNull() & column(id_col).isNotNull() & F.coalesce(fine, F.lit(False)) & fits)
    return whole.select(column(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


class SlicedBlock:
    """Rows of one block: exact vectors, ids and bit slices of the quantised attributes."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, bits: int = BITS):
        self.ids, self.v, self.n, self.bits = ids, v, len(ids), bits
        self.low = v.min(0) if len(v) else 0
        spread = int((v.max(0) - self.low).max()) if v.size else 0
        self.shift = max(0, spread.bit_length() - bits)
        u = (v - self.low) >> self.shift
        self.width = max(1, int(u.max()).bit_length()) if u.size else 1
        words = -(-self.n // 64)
        slices = np.zeros((v.shape[1], self.width, words * 64), np.uint8)
        for b in range(self.width):
            slices[:, b, : self.n] = ((u >> b) & 1).T
        self.full = np.zeros(words * 64, np.uint8)
        self.full[: self.n] = 1
        self.full = np.packbits(self.full, bitorder="little").view("<u8")
        self.slices = np.packbits(slices, axis=2, bitorder="little").view("<u8")
        self.mirror = self.slices ^ self.full  # complements, for negative weights

    def sums(self, q: np.ndarray) -> list[np.ndarray]:
        """Bit slices, lowest first, of the sum over attributes of |q| times the (mirrored) quantised value."""
        planes: list[list[np.ndarray]] = []
        size = np.abs(q).astype(object)
        for b in range(max(int(x).bit_length() for x in size) if len(size) else 0):
            on = np.array([bool(int(x) >> b & 1) for x in size])
            up, down = np.flatnonzero(on & (q > 0)), np.flatnonzero(on & (q < 0))
            for w in range(self.width):
                while len(planes) <= b + w:
                    planes.append([])
                planes[b + w] += [self.slices[up, w], self.mirror[down, w]]
        out: list[np.ndarray] = []
        at = 0
        carries: list[np.ndarray] = []
        while at < len(planes) or any(len(c) for c in carries):
            stack = [p for p in (planes[at] if at < len(planes) else []) + carries if len(p)]
            carries = []
            rows = np.concatenate(stack) if stack else np.zeros((0, len(self.full)), np.uint64)
            while len(rows) > 2:
                t = len(rows) // 3
                a, b, c = rows[:t], rows[t : 2 * t], rows[2 * t : 3 * t]
                ab = a ^ b
                carries.append((a & b) | (c & ab))
                rows = np.concatenate([ab ^ c, rows[3 * t :]])
            if len(rows) == 2:
                carries.append((rows[:1] & rows[1:]))
                rows = rows[:1] ^ rows[1:]
            out.append(rows[0] if len(rows) else np.zeros(len(self.full), np.uint64))
            at += 1
        return out

    def kth(self, sums: list[np.ndarray], k: int) -> int:
        """The k-th highest sum (the lowest, if there are fewer rows), from the top slice down."""
        need, left, value = min(k, self.n), self.full, 0
        for b in range(len(sums) - 1, -1, -1):
            high = left & sums[b]
            count = int(np.bitwise_count(high).sum())
            if count >= need:
                left, value = high, value | 1 << b
            else:
                need, left = need - count, left & ~sums[b]
        return value

    def at_least(self, sums: list[np.ndarray], bound: int) -> np.ndarray:
        """Rows whose sum is bound or more."""
        if bound <= 0:
            return np.arange(self.n)
        above, equal = np.zeros_like(self.full), self.full
        for b in range(max(len(sums), bound.bit_length()) - 1, -1, -1):
            s = sums[b] if b < len(sums) else np.zeros_like(self.full)
            if bound >> b & 1:
                equal = equal & s
            else:
                above, equal = above | (equal & s), equal & ~s
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little")[: self.n])

    def search(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, vec_id) of the k best rows of the block but the query's own, ties to smaller ids."""
        if not self.n:
            return []
        sums = self.sums(q)
        slack = int(np.abs(q).astype(object).sum()) * ((1 << self.shift) - 1) >> self.shift  # what the dropped bits can add
        rows = self.at_least(sums, self.kth(sums, k + int(np.count_nonzero(self.ids == query_id))) - slack - 1)
        rows = rows[self.ids[rows] != query_id]
        scores = self.v[rows] @ q
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return list(zip(scores[best].tolist(), self.ids[rows][best].tolist()))


def _matrix(vectors: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(vectors), dim)


def _narrow(m: np.ndarray) -> bytes:
    """The matrix in the smallest whole type that holds it, the type's size first."""
    top = int(np.abs(m).max(initial=0))
    size = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([size]) + m.astype(f"<i{size}").tobytes()


def _wide(data: bytes, n: int, dim: int) -> np.ndarray:
    if not n * dim:
        return np.zeros((n, dim), np.int64)
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64).reshape(n, dim)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK, bits: int = BITS) -> DataFrame:
    """(query_id, rank, vec_id, score) of rows (vec_id, v) as quantised() gives them, for queries of the same form.

    A query's own rows are those of its vec_id. Only vectors of equal length are compared. Repeated
    rows are candidates each; a repeated query counts once, and one id with several vectors asks
    with each of them and keeps the best rows of all. Empty tables and no queries give no rows.
    """
    rows = stash(vectors.withColumn("dim", F.size("v")), "topk-rows")
    asked = queries.select("vec_id", "v").distinct().withColumn("dim", F.size("v"))
    row_blocks, query_blocks = -(-max(1, rows.count()) // row_block), -(-max(1, asked.count()) // query_block)
    pairs = row_blocks * query_blocks

    def bundle(key, t):
        dim = key[0].as_py()
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()),
            "ids": pa.array([t.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()), "data": pa.array([_narrow(_matrix(t.column("v"), dim))], pa.binary()),
        })

    def pack(df, key, n):
        return df.withColumn("block", F.pmod(key, F.lit(n)).cast("long")).groupBy("dim", "block").applyInArrow(bundle, "dim int, block long, ids binary, data binary")

    # both sides name each (row block, query block) pair by one number; ranges of it are the tasks
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    ask = pack(asked, F.xxhash64("vec_id", "v"), query_blocks).withColumn("other", every(row_blocks))
    ask = ask.select((F.col("other") * query_blocks + F.col("block")).alias("pair"), "dim", F.lit(0).alias("side"), "ids", "data")
    index = pack(rows, F.monotonically_increasing_id(), row_blocks).withColumn("other", every(query_blocks))
    index = index.select((F.col("block") * query_blocks + F.col("other")).alias("pair"), "dim", F.lit(1).alias("side"), "ids", "data")
    met = stash(ask.unionAll(index), "topk-pairs").repartitionByRange(pairs, "pair").sortWithinPartitions("pair", "dim", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asking = None, None
        for b in batches:
            for pair, dim, side, ids, data in zip(*(b.column(c) for c in range(5))):
                at, own = (pair.as_py(), dim.as_py()), np.frombuffer(ids.as_py(), "<i8")
                if side.as_py() == 0:  # the pair's queries come before its rows
                    held, asking = at, (own, _wide(data.as_py(), len(own), at[1]))
                elif held == at:
                    block, out = SlicedBlock(own, _wide(data.as_py(), len(own), at[1]), bits), []
                    for i, q in zip(asking[0].tolist(), asking[1]):
                        out += [(i, v, s) for s, v in block.search(i, q, k)]
                    cols = list(zip(*out)) or [()] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
