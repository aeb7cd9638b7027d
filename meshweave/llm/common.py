"""Helpers shared by the text operators: tables, components, tokenizers; stash() writes to the shared folder and reads back."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import mark, only_last
from ..plans.storage import materialise as stash

__all__ = ["column", "connected_components", "fast_encoder", "fresh_name", "load_tokenizer", "spanning", "stash", "table", "tokenizer_file", "vocabulary"]

#: Edges that one task contracts at once.
PART_EDGES = 250_000


def fresh_name(taken, base: str) -> str:
    """base, or base with underscores behind it until no column (compared without case) has the name."""
    have = {c.lower() for c in taken}
    while base.lower() in have:
        base += "_"
    return base


def column(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spanning(i: np.ndarray, j: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from nodes to the smallest node they reach over the pairs (i, j) of indexes."""
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _contract(batches):
    """A partition's edges as stars around their smallest nodes."""
    parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if parts:
        t = pa.concat_tables(parts)
        nodes, at = np.unique(np.concatenate([t.column("a").to_numpy(), t.column("b").to_numpy()]), return_inverse=True)
        half = len(at) // 2
        a, b = spanning(at[:half], at[half:], nodes)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, root) for every node of undirected edges (a, b); root is the smallest node reachable.

    Edges (longs) are first contracted to stars within bounded parts of PART_EDGES; one part holding
    all is the answer. More parts go on in alternating large-star and small-star rounds. Minima are
    pre-aggregated map-side, the joins back are plain equi-joins that adaptive execution can split
    for a hub, and each round is stashed in place of the one before, so neither lineage nor a task
    grows with a component.
    Null ends and loops are ignored.
    """

    def digest(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    spark, start = edges.sparkSession, mark()
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = stash(e.where("a is not null and b is not null and a <> b"), tag)
    parts = max(1, -(-e.count() // PART_EDGES))
    e = stash(e.repartition(parts).mapInArrow(_contract, "a long, b long"), tag)
    only_last(spark, start)
    before = digest(e) if parts > 1 else (0, None)
    while before[0]:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        pairs = large.join(low, F.col("a") == F.col("k")).select("a", "b", "m")
        small = pairs.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        e = stash(small, tag)
        only_last(spark, start)
        after = digest(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@functools.lru_cache(maxsize=1)
def _byte_of_char() -> dict[str, int]:
    """The byte each printable stand-in character of a byte-level vocabulary denotes."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[list[bytes], dict[str, int]]:
    """Bytes of every id, and the special strings with their ids, of a byte-level tokenizer file."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte = _byte_of_char()
    pieces = [b""] * (1 + max([*spec["model"]["vocab"].values(), *special.values()]))
    for text, i in spec["model"]["vocab"].items():
        pieces[i] = bytes(byte[c] for c in text) if all(c in byte for c in text) else text.encode()
    for text, i in special.items():
        pieces[i] = text.encode()
    return pieces, special


@functools.lru_cache(maxsize=4)
def ids_are_ranks(path: str) -> bool:
    """Whether a tokenizer file is a plain byte-level one whose pieces' ids rise in the order of their merges."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or not all(c in model["vocab"] for c in _byte_of_char()):
        return False
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    last_byte = max(model["vocab"][c] for c in _byte_of_char())
    return all(a < b for a, b in zip([last_byte, *made], made))


@functools.lru_cache(maxsize=4)
def fast_encoder(path: str):
    """text -> uint32 ids, equal to load_tokenizer(path).encode(text, add_special_tokens=False).

    Where ids are merge ranks, the rank-based library gives the same ids several times faster; texts
    its regex engine refuses, and vocabularies of another build, go to the tokenizers library itself.
    """
    import numpy as np
    import public_tokenizers
    import tiktoken

    if not ids_are_ranks(path):
        return lambda text: np.asarray(load_tokenizer(path).encode(text, add_special_tokens=False).ids, dtype="<u4")
    pieces, special = vocabulary(path)
    own = set(special.values())
    ranks = {b: i for i, b in enumerate(pieces) if i not in own}
    enc = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)

    def encode(text: str):
        try:
            return np.asarray(enc.encode_to_numpy(text, allowed_special=allowed), dtype="<u4")
        except Exception:  # the regex engine's own stack limit on runs of millions of blanks
            return np.asarray(load_tokenizer(path).encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode
