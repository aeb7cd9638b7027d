"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are read in overlapping chunks that cover all of it. Byte embeddings and learned
filters are folded into one table of filter responses by place in the chunk and byte, so scoring a
chunk is a sum of table rows. Each filter keeps its largest response over the text (and the share of
chunks it fires on), and a logistic unit combines them into one probability.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, stash

CHUNK, STRIDE, FILTERS, DIMS = 16, 4, 24, 8
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 64 << 20
EPOCHS, RATE, SEED = 6, 0.01, 7
PIECE = 1 << 16


def _chunks(text: str | None) -> np.ndarray:
    """Byte rows of the overlapping chunks, zero-padded at the end so that every byte lies in one."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    n = max(1, -(-(len(raw) - CHUNK) // STRIDE) + 1) if len(raw) > CHUNK else 1
    padded = np.zeros(CHUNK + (n - 1) * STRIDE, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STRIDE]


class Network:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (256, DIMS)).astype(np.float32), "filters": r.normal(0, 0.25, (CHUNK, DIMS, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32), "top": r.normal(0, 0.1, 2 * FILTERS).astype(np.float32), "out": np.zeros(1, np.float32),
        }
        self.table = None

    def fold(self) -> np.ndarray:
        """Responses by (place, byte, filter)."""
        return np.ascontiguousarray(np.einsum("bd,kdf->kbf", self.p["embed"], self.p["filters"]))

    @staticmethod
    def responses(table: np.ndarray, chunks: np.ndarray) -> np.ndarray:
        total = table[0][chunks[:, 0]]
        for k in range(1, CHUNK):
            total += table[k][chunks[:, k]]
        return total

    def pooled(self, table: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter and the share of chunks above zero, in bounded pieces."""
        best, fired = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS)
        for a in range(0, len(chunks), PIECE):
            got = self.responses(table, chunks[a : a + PIECE]) + self.p["bias"]
            best = np.maximum(best, got.max(0))
            fired += (got > 0).sum(0)
        return best, (fired / len(chunks)).astype(np.float32)

    def score(self, text: str | None) -> float:
        if self.table is None:
            self.table = self.fold()
        best, share = self.pooled(self.table, _chunks(text))
        z = float(np.concatenate([np.tanh(best), share]) @ self.p["top"] + self.p["out"][0])
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))

    def train(self, texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, batch: int = 32, seed: int = SEED) -> None:
        """Adam on the log loss. Maxima pass gradients to their chunk, shares through a soft step at a few chunks."""
        r = np.random.default_rng(seed)
        rows = [_chunks(t) for t in texts]
        y = np.asarray(labels, np.float32)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(rows))
            for a in range(0, len(order), batch):
                grads = {k: np.zeros_like(v) for k, v in self.p.items()}
                table = self.fold()
                for i in order[a : a + batch].tolist():
                    self._backward(table, rows[i], y[i], grads, r)
                step += 1
                for k, g in grads.items():
                    g /= batch
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.table = None

    def _backward(self, table, chunks, y, grads, r) -> None:
        """Adds one text's gradients; its responses are read in pieces of PIECE chunks, however long it is."""
        top, at, fired = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.int64), np.zeros(FILTERS)
        for a in range(0, len(chunks), PIECE):
            got = self.responses(table, chunks[a : a + PIECE]) + self.p["bias"]
            place = got.argmax(0)
            high = got[place, np.arange(FILTERS)]
            at[high > top] = a + place[high > top]
            top = np.maximum(top, high)
            fired += (got > 0).sum(0)
        best = np.tanh(top)
        share = (fired / len(chunks)).astype(np.float32)
        x = np.concatenate([best, share])
        z = float(x @ self.p["top"] + self.p["out"][0])
        d = np.float32(1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        grads["top"] += d * x
        grads["out"] += d
        picks = r.integers(0, len(chunks), 32)
        soft = 1 / (1 + np.exp(-np.clip(self.responses(table, chunks[picks]) + self.p["bias"], -30, 30)))
        where = np.concatenate([at, picks])
        g = np.zeros((len(where), FILTERS), np.float32)
        g[np.arange(FILTERS), np.arange(FILTERS)] = d * self.p["top"][:FILTERS] * (1 - best * best)
        g[FILTERS:] += d * self.p["top"][FILTERS:] * soft * (1 - soft) / len(picks)
        grads["bias"] += g.sum(0)
        own = chunks[where].astype(np.int64)
        e = self.p["embed"][own]
        grads["filters"] += np.einsum("nkd,nf->kdf", e, g)
        np.add.at(grads["embed"], own.ravel(), np.einsum("nf,kdf->nkd", g, self.p["filters"]).reshape(-1, DIMS))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Network:
        net = cls()
        with np.load(io.BytesIO(data)) as f:
            net.p = {k: f[k] for k in f.files}
        return net


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt from; a null id counts as such."""
    return F.coalesce(F.crc32(column(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """Train on a bounded sample of the labelled rows outside the held-out third; returns the network.

    The sample is the first sample_rows labelled ids in hash order, so the same at any layout, each
    with its whole text, up to the row that reaches sample_bytes of text in all: both parameters
    bound what reaches the driver, and no text is left out or cut for its length. Of several rows of
    an id the greatest text is learnt from. Null labels and ids are not used; a null text is an empty
    one. With no usable row, or one class only, the network keeps its first weights and scores near
    one half.
    """
    known = labels.where(column(id_col).isNotNull() & column(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(column(id_col).alias("id")).agg(F.max(column(label_col)).cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(column(id_col).alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picked), "id").groupBy("id", "label").agg(F.max("text").alias("text"))
    rows = stash(rows.select("id", "label", "text", F.octet_length("text").alias("n"), F.xxhash64("id").alias("place")), "quality-sample")
    total, last = 0, None
    for r in sorted(rows.select("place", "id", "n").collect()):  # at most sample_rows sizes
        last, total = r["place"], total + r["n"]
        if total >= sample_bytes:
            break
    whole = rows if last is None else rows.where(F.col("place") <= last)
    sample = sorted(tuple(r) for r in whole.select("id", "label", "text").collect())
    net = Network()
    if len({s[1] for s in sample}) > 1:
        net.train([s[2] for s in sample], [s[1] for s in sample])
    return net.dump()


def score(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score in 0..1, predicted.

    Whole texts are read. Null and empty texts get the score of an empty text; repeated rows and
    null ids pass through; an empty table gives an empty one; other columns are left out.
    """
    source = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.load(model)
        for b in batches:
            p = np.array([net.score(t.as_py()) for t in b.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns unchanged, whose text scores at least one half."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.load(model)
        for b in batches:
            texts = b.column(at)
            yield b.filter(pa.array([net.score(t.as_py()) >= 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
