"""Hard-negative mining by blocked dense products.

Candidates are bundled once into blocks of whole vectors, anchors into blocks of their own. A bounded
number of anchor blocks at a time is broadcast to the candidate blocks; a task multiplies its blocks
with them in float64, which is exact while sums stay below 2**53 (whole-number products take over
beyond), and keeps only each anchor's best rows so far, so what it hands on does not grow with its
blocks. The first pass finds the positives, the second the best negatives in each positive's window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, stash

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: Vectors of a block of anchors and of candidates, and bytes of a block as float64.
ANCHOR_ROWS, ROWS, BLOCK_BYTES = 1024, 4096, 4 << 20
#: Anchor blocks that are broadcast at once: at most 64 MB.
AT_ONCE = 16
#: A window of negatives for a positive of score p: LOW * p <= 100 * score <= HIGH * p.
LOW, HIGH = 50, 95
LEAST = np.iinfo(np.int64).min


def prepared(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): floored integer vectors of the rows that take part.

    Rows with a null id, label, vector or component, or one that is not finite, take no part. Nor do
    vectors of dimension d with a floored component m of d * m * m >= 2**63: their scores need not fit a long.
    """
    x = column(vec_col).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    top = F.array_max(F.transform(x, lambda c: F.abs(c) * scale + 1))
    fits = F.coalesce(top * top * F.size(x) < float(2**63), F.lit(True))  # an empty vector has no largest component
    there = column(id_col).isNotNull() & column(label_col).isNotNull() & column(vec_col).isNotNull() & F.coalesce(fine, F.lit(False)) & fits
    whole = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    return vectors.where(there).select(column(id_col).cast("long").alias("vec_id"), column(label_col).cast("long").alias("label"), whole.alias("v"))


def _bundles(most: int):
    """Rows (vec_id, label, v) of a partition as blocks of at most `most` vectors of one length."""

    def block(dim, ids, labels, vectors):
        data = [pa.array([x], t) for x, t in ((dim, pa.int32()), (np.concatenate(ids).tobytes(), pa.binary()), (np.concatenate(labels).tobytes(), pa.binary()), (np.concatenate(vectors).tobytes(), pa.binary()))]
        return pa.RecordBatch.from_arrays(data, names=["dim", "ids", "labels", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        for b in batches:
            ids, labels, v = (b.column(c) for c in ("vec_id", "label", "v"))
            sizes, flat, starts = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(), v.offsets.to_numpy()[:-1] - v.offsets[0].as_py()
            for dim in np.unique(sizes).tolist():
                rows, limit = np.flatnonzero(sizes == dim), max(1, min(most, BLOCK_BYTES // (8 * max(1, dim))))
                for at in np.split(rows, range(limit, len(rows), limit)):
                    mine = held.setdefault(dim, ([], [], []))
                    if mine[0] and sum(map(len, mine[0])) + len(at) > limit:
                        yield block(dim, *mine)
                        mine = held[dim] = ([], [], [])
                    for kept, x in zip(mine, (ids.to_numpy()[at], labels.to_numpy()[at], flat[(starts[at][:, None] + np.arange(dim)).ravel()])):
                        kept.append(x)
        for dim, mine in held.items():
            yield block(dim, *mine)

    return run


def _opened(ids: bytes, labels: bytes, data: bytes, dim: int):
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(labels, np.int64), np.frombuffer(data, np.int64).reshape(len(own), dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors: float64 while no sum can reach 2**53, longs beyond."""
    top = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    return a.astype(np.float64) @ b.T.astype(np.float64) if top < 1 << 53 else a @ b.T


class Best:
    """The k best (score, id) of each of n anchors so far: higher scores first, ties by smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), LEAST), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Rows allowed[anchor, row] of scores[anchor, row]. What ties with an anchor's last place is looked at too."""
        last = self.scores[:, -1].astype(scores.dtype)
        allowed = allowed & (scores >= last[:, None])
        some = np.flatnonzero(allowed.any(1))
        if not len(some):
            return
        allowed, scores = allowed[some], scores[some]
        if scores.shape[1] > self.k:
            least = -np.inf if scores.dtype.kind == "f" else LEAST
            kth = np.partition(np.where(allowed, scores, least), -self.k, axis=1)[:, -self.k]
            allowed &= scores >= kth[:, None]
        row, at = np.nonzero(allowed)
        row, new = some[row], scores[row, at].astype(np.int64)
        row = np.concatenate([row, np.repeat(some, self.k)])
        new = np.concatenate([new, self.scores[some].ravel()])
        own = np.concatenate([ids[at], self.ids[some].ravel()])
        order = np.lexsort((own, ~new, row))  # ~x falls as x rises, and never overflows
        row, new, own = row[order], new[order], own[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        top = place < self.k
        self.scores[row[top], place[top]], self.ids[row[top], place[top]] = new[top], own[top]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, score, id) of the places that are taken."""
        at, place = np.nonzero(self.scores > LEAST)
        return at, self.scores[at, place], self.ids[at, place]


def _pass(anchors: DataFrame, rows: DataFrame, blocks: list[int], meet: Callable, result: Callable, schema: str, k: int, *group: str) -> DataFrame:
    """One meeting of all anchor blocks with all candidate blocks; the k best by group of what the tasks hand on.

    meet(state, anchor row, candidate block) takes in one pair of blocks, result(block, state) turns a
    task's state of an anchor block into columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, tuple] = {}
        for b in batches:
            for r in b.to_pylist():
                states[r["block"]] = meet(states.get(r["block"]), r, _opened(r["ids"], r["labels"], r["data"], r["dim"]))
        for block, state in states.items():
            for cols in result(block, state):
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[c.split()[0] for c in schema.split(", ")])

    found = None
    for at in range(0, len(blocks), AT_ONCE):
        now = anchors.where(F.col("block").isin(blocks[at : at + AT_ONCE]))  # at most AT_ONCE * BLOCK_BYTES
        part = rows.join(F.broadcast(now), "dim").mapInArrow(run, schema)
        place = F.row_number().over(Window.partitionBy("block", *group).orderBy(F.col("score").desc(), "id"))
        part = stash(part.withColumn("rank", place).where(F.col("rank") <= k), "mining-best")
        found = part if found is None else found.unionByName(part)
    return found


def window(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest whole score in the window of positives of score p, without products that leave the longs."""
    part = lambda x, share: x // 100 * share + x % 100 * share // 100
    return -part(-p, LOW), part(p, HIGH)


def _positive(k: int) -> tuple[Callable, Callable]:
    """meet and result of the first pass."""

    def meet(state, r, rows):
        if state is None:
            own = _opened(r["a_ids"], r["a_labels"], r["a_data"], r["dim"])
            state = own, Best(len(own[0]), k)
        (ids, labels, v), best = state
        best.add(products(v, rows[2]), (labels[:, None] == rows[1]) & (ids[:, None] != rows[0]), rows[0])
        return state

    def result(block, state):
        at, score, ids = state[1].rows()
        yield np.full(len(at), block), at, score, ids

    return meet, result


def _negative(k: int) -> tuple[Callable, Callable]:
    """meet and result of the second pass, whose anchor rows also hold the positives (at, rank, score)."""

    def windows(n, wanted):
        at, rank, score = (np.array([w[c] for w in wanted], np.int64) for c in ("at", "rank", "score"))
        low, high = window(score)
        for place in range(1, int(rank.max(initial=0)) + 1):
            lo, hi, mine = np.full(n, 1), np.full(n, 0), rank == place  # an empty window for anchors with fewer positives
            lo[at[mine]], hi[at[mine]] = low[mine], high[mine]
            yield lo, hi, Best(n, k)

    def meet(state, r, rows):
        if state is None:
            own = _opened(r["a_ids"], r["a_labels"], r["a_data"], r["dim"])
            state = own, list(windows(len(own[0]), r["positives"]))
        (ids, labels, v), wanted = state
        scores, other = products(v, rows[2]), (labels[:, None] != rows[1]) & (ids[:, None] != rows[0])
        for lo, hi, best in wanted:
            lo, hi = lo.astype(scores.dtype)[:, None], hi.astype(scores.dtype)[:, None]
            best.add(scores, other & (scores >= lo) & (scores <= hi), rows[0])
        return state

    def result(block, state):
        for place, (_, _, best) in enumerate(state[1], 1):
            at, score, ids = best.rows()
            yield np.full(len(at), block), at, score, ids, np.full(len(at), place, np.int32)

    return meet, result


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, anchor_rows: int = ANCHOR_ROWS, block_rows: int = ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows as prepared() gives them.

    anchors says which rows are anchors. A row's score is its inner product with the anchor; higher ones
    come first, ties by the smaller id. Rows of the anchor's own id are neither positives nor negatives.
    An anchor's positives are the first of the rows of its label; for each, the first `negatives` rows of other labels in its window are
    returned. Anchors without positives, and windows without rows, return nothing.
    Repeated rows are rows each: a repeated anchor asks each time, a repeated row fills several places.
    Only vectors of equal length are compared. An empty table gives no rows.
    """
    schema = "block long, at long, score long, id long"
    asks = stash(rows.where(anchors), "mining-asks")
    parts = max(1, -(-asks.count() // anchor_rows))
    asked = asks.repartition(parts).mapInArrow(_bundles(anchor_rows), "dim int, ids binary, labels binary, data binary")
    asked = stash(asked.withColumn("block", F.monotonically_increasing_id()), "mining-anchors")
    blocks = [r[0] for r in asked.select("block").collect()]  # one number to 1,024 anchors
    held = stash(rows.mapInArrow(_bundles(block_rows), "dim int, ids binary, labels binary, data binary"), "mining-blocks")
    side = asked.select("block", "dim", *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "data")])

    near = _pass(side, held, blocks, *_positive(positives), schema, positives, "at")
    if near is None:
        empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return rows.sparkSession.createDataFrame([], empty)
    wanted = near.groupBy("block").agg(F.collect_list(F.struct("at", "rank", "score")).alias("positives"))  # a block's anchors: bounded
    hard = _pass(side.join(wanted, "block"), held, blocks, *_negative(negatives), schema + ", positive int", negatives, "at", "positive")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, ids in zip(b.column("block").to_pylist(), b.column("ids")):
                own = np.frombuffer(ids.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(np.arange(len(own))), pa.array(own)], names=["block", "at", "anchor_id"])

    names = asked.select("block", "ids").mapInArrow(numbered, "block long, at long, anchor_id long")
    near = near.select("block", "at", F.col("rank").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(near, ["block", "at", "positive"]).join(names, ["block", "at"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
