"""SimHash near-duplicates: exact comparison in tiles of equal population counts.

Fingerprints are compared once each, however many documents share one. The population counts of a
fingerprint's four 16-bit words name its tile; two tiles whose counts differ by more than the radius
in sum hold no pair within it and never meet. Tiles are bounded: a crowded one is split by hash, and
every part still meets every neighbour. Within a tile numpy does exclusive-or and bit counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, connected_components, fresh_name, spanning, stash

RADIUS = 3
SHINGLE = 3
SEED = 42
TILE = 4096
BLOCK = 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; bit i is set if it is set in more than half of the shingles' hashes. No words: zero."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = np.concatenate(([0], ends[:-1] + 1))
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, 65536):
        z = min(n, a + 65536)
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[a:z].tolist(), ends[a + shingle - 1 : z + shingle - 1].tolist())], np.uint64)
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, and the string columns in keep): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], names=["doc_id", "fp", *keep])

    source = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"), *[column(c) for c in keep])
    return source.mapInArrow(run, "doc_id long, fp long" + "".join(f", {c} string" for c in keep))


def _counts(fp: str):
    return [F.bit_count(F.shiftrightunsigned(F.col(fp), 16 * i).bitwiseAND(F.lit(65535))).cast("int") for i in range(4)]


def _code(words):
    code = words[0]
    for w in words[1:]:
        code = code * 17 + w
    return code


def half_ball(radius: int) -> list[tuple[int, ...]]:
    """Count differences of sum at most radius, one of each opposite pair, zero first."""
    ball = [d for d in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    return sorted(d for d in ball if d >= (0, 0, 0, 0))


def block_links(home: np.ndarray, met: np.ndarray, radius: int, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links between home and met, a forest per block pair; own: met is home itself."""
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for h in range(0, len(home), BLOCK):
        left = home[h : h + BLOCK]
        for g in range(h if own else 0, len(met), BLOCK):
            right = met[g : g + BLOCK]
            near = np.bitwise_count(left[:, None] ^ right[None, :]) <= radius
            if own and g == h:
                near &= np.tri(len(left), len(right), -1, dtype=bool)
            i, j = np.nonzero(near)
            if len(i):
                x, y = spanning(i, j + len(left), np.concatenate([left, right]))
                a.append(x)
                b.append(y)
    return np.concatenate(a), np.concatenate(b)


def _compare(radius: int):
    """Blocks (tile, fps, guest) sorted by tile, its own before its guests: the former are held, guests stream by."""

    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, last = np.zeros(0, np.uint64), None
        for batch in batches:
            tiles, blocks = batch.column(0).to_numpy(), batch.column(1)
            fps, at = blocks.values.to_numpy().view(np.uint64), blocks.offsets.to_numpy()
            away = batch.column(2).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(tiles)) + 1).tolist(), len(tiles)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if tiles[a] != last:
                    yield edges(*block_links(home, home, radius, True))
                    home, last = np.zeros(0, np.uint64), tiles[a]
                m = z - int(away[a:z].sum())
                home = np.concatenate([home, fps[at[a] : at[m]]])
                if m < z and len(home):
                    yield edges(*block_links(home, fps[at[m] : at[z]], radius))
        yield edges(*block_links(home, home, radius, True))

    return run


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (column fp) whose components are the linked groups.

    A tile's fingerprints are written as one block for each of its parts, some `tile` fingerprints by their
    hash. Blocks meet themselves and, as guests, go whole to the other parts and to the half of the tiles near
    theirs. The tile list has at most 17**4 rows, which is what is broadcast.
    """
    coded = distinct.select("fp", _code(_counts("fp")).alias("code"))
    sizes = F.broadcast(coded.groupBy("code").count().select("code", F.ceil(F.col("count") / tile).cast("int").alias("parts")))
    homes = coded.join(sizes, "code").select("fp", "code", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"), "parts")
    blocks = stash(homes.groupBy("code", "part", "parts").agg(F.collect_list("fp").alias("fps")), "simhash-blocks")

    def sent(df: DataFrame, part: str, guest: bool) -> DataFrame:
        return df.select((F.col("code").cast("long") * 1048576 + F.col(part)).alias("tile"), "fps", F.lit(guest).alias("guest"))

    # parts of one tile meet too: a part is a guest of the later parts
    within = blocks.where("part + 1 < parts").select("code", "fps", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("other"))
    own_counts = F.array(*[F.floor(F.col("code") / 17**k).cast("int") % 17 for k in (3, 2, 1, 0)])
    steps = F.array(*[F.array(*map(F.lit, d)) for d in half_ball(radius)[1:]])

    def moved(step):
        to = F.zip_with(own_counts, step, lambda c, d: c + d)
        return F.when(F.forall(to, lambda c: c.between(0, 16)), F.aggregate(to, F.lit(0), lambda acc, c: acc * 17 + c))

    near = blocks.select("fps", F.explode(F.array_compact(F.transform(steps, moved))).alias("code")).join(sizes, "code")
    guests = near.select("code", "fps", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = sent(blocks, "part", False).unionAll(sent(within, "other", True)).unionAll(sent(guests, "other", True))
    return met.repartition("tile").sortWithinPartitions("tile", "guest").mapInArrow(_compare(radius), "a long, b long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, fp, component_id, the smallest doc_id reachable over links, and what keep names.

    Null and empty texts have fingerprint zero and link like any other; repeated rows give repeated
    rows; null ids stay null and take part through their fingerprint only; an empty table gives an
    empty one; other columns are left out.
    """
    return _rooted(docs, id_col, text_col, radius, keep).select("doc_id", "fp", "component_id", *keep)


def _rooted(docs: DataFrame, id_col: str, text_col: str, radius: int, keep: tuple[str, ...]) -> DataFrame:
    prints = stash(fingerprints(docs, id_col, text_col, keep), "simhash")
    distinct = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-fp")
    roots = connected_components(links(distinct, radius), "simhash-cc")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select("fp", "root", "component_id")
    return stash(prints.join(named, "fp").select("doc_id", "fp", "root", "component_id", *keep), "simhash-rooted")


#: Rows of the flag table of keep_one up to which it is broadcast (some 100 bytes each in memory).
BROADCAST_ROWS = 500_000


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs without all but one row of each linked group: the smallest id's, null ids last.

    Rows of that id within the group are ordered by their text's digest and one of them is kept, so
    repeated rows go too. What is joined back are ids and digests of the rows that go and of those
    that repeat, counted before they are broadcast; past BROADCAST_ROWS they are joined by key.
    """
    digest, same, flag = (fresh_name(docs.columns, x) for x in ("digest", "same", "flag"))
    raw = F.coalesce(column(text_col), F.lit("")).cast("binary")
    tagged = docs.select(*[column(c) for c in docs.columns], F.unhex(F.substring(F.sha2(raw, 256), 1, 32)).alias(digest), column(id_col).cast("long").alias(same))
    found = _rooted(tagged.select(column(id_col), column(text_col), F.hex(column(digest)).alias("digest")), id_col, text_col, radius, ("digest",))
    counted = found.groupBy("root", "component_id", "doc_id", "digest").agg(F.count("*").alias("n"))
    # other ids than the smallest go; among the rows of that id (or of none, where all ids are null) the least digest stays
    lowest = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = counted.where(lowest).groupBy("root").agg(F.min("digest").alias("least"))
    rated = counted.where(lowest).join(first, "root").select("doc_id", "digest", "n", (F.col("digest") == F.col("least")).alias("kept"))
    rated = rated.unionAll(counted.where(~lowest).select("doc_id", "digest", "n", F.lit(False)))
    flags = rated.where("not kept or n > 1").select(F.col("doc_id").alias("flag_id"), F.unhex("digest").alias("flag_digest"), F.when(F.col("kept"), "once").otherwise("drop").alias(flag))
    flags = stash(flags, "simhash-flags")
    few = F.broadcast(flags) if flags.count() <= BROADCAST_ROWS else flags
    marked = tagged.join(few, column(same).eqNullSafe(F.col("flag_id")) & (column(digest) == F.col("flag_digest")), "left")
    alone = marked.where(column(flag).isNull())
    repeated = marked.where(column(flag) == "once").dropDuplicates([same, digest])
    return alone.unionByName(repeated).select(*[column(c) for c in docs.columns])
