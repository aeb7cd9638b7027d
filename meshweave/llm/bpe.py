"""BPE encoding and decoding through a distinct-word table.

Texts are split into words block by block (a block is a bounded run of documents of one input
task). A block keeps, per document, the positions as indexes into its own distinct words, and deals
those words into hash buckets. Each bucket encodes every distinct word it meets once; the ids go
back to the blocks and are joined to the documents by position. What is shuffled is one packed row
per block and bucket, so a word that makes up a third of the corpus costs one entry per block.

Texts are decoded from ids through the id-to-piece table, whose size is the vocabulary's. encode()
joins it where the ids are, at a block's distinct words, so that no id is shuffled for it; decode()
does the same for any table of ids as a broadcast join.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, load_tokenizer, tokenizer_file, vocabulary

BLOCK_BYTES = 16 << 20
#: Hash buckets of words: one for so many documents, within these bounds. All words are in some bucket.
DOCS_PER_BUCKET, MIN_BUCKETS, MAX_BUCKETS = 4000, 64, 4096
SPLIT = "block long, bucket int, data binary"


@functools.lru_cache(maxsize=1)
def _words():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN).findall


def split_words(text: str, special: tuple[str, ...]) -> list[str]:
    """The pieces the tokenizer encodes one by one; special strings stand alone."""
    parts = [text]
    for s in special:
        parts = [x for p in parts for x in ([p] if p == s else [y for q in p.split(s) for y in (s, q)][1:] if s in p else [p])]
    find, out = _words(), []
    for p in parts:
        out.extend([p] if p in special else find(p))
    return out


def _pack(values) -> bytes:
    """Unsigned 32-bit values, byte planes apart, compressed."""
    import zstandard

    a = np.asarray(values, dtype="<u4")
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_codes(codes: np.ndarray) -> bytes:
    """Small codes in one byte; the rest of larger ones in planes after them."""
    import zstandard

    small = codes < 128
    rest = codes[~small]
    first = np.where(small, codes, 128 + (codes & 127)).astype(np.uint8)
    return zstandard.compress(b"".join([first.tobytes(), *((rest >> s & 255).astype(np.uint8).tobytes() for s in (7, 15, 23))]), 1)


def _unpack_codes(data: bytes, n: int) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    codes = raw[:n].astype(np.int64)
    large = codes >= 128
    planes = raw[n:].reshape(3, -1).astype(np.int64)
    codes[large] += (planes[0] << 7) + (planes[1] << 15) + (planes[2] << 23) - 128
    return codes


def _join(parts: list[bytes]) -> bytes:
    head = np.array([len(parts), *map(len, parts)], dtype="<u4").tobytes()
    return head + b"".join(parts)


def _part(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(data, "<u4", n, 4).astype(np.int64)) + 4 + 4 * n
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist())]


def _splitter(path: str, n_buckets: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        special = tuple(vocabulary(path)[1])
        task, made = TaskContext.get().partitionId(), 0
        index: dict[str, int] = defaultdict()
        index.default_factory = index.__len__
        ids: list[int | None] = []
        codes: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal made, size
            block = task << 32 | made
            words, code = list(index), np.concatenate(codes)
            # repeated words by falling count, then those met once, in the order of the texts: code 0 stands for the next of these
            count = np.bincount(code, minlength=len(words))
            many = np.flatnonzero(count > 1)
            many = many[np.argsort(-count[many], kind="stable")]
            number = np.zeros(len(words), np.int64)
            number[many] = np.arange(1, len(many) + 1)
            words = [words[i].encode() for i in [*many.tolist(), *np.flatnonzero(count == 1).tolist()]]
            bucket = np.fromiter((zlib.crc32(w) % n_buckets for w in words), np.uint32, len(words))
            known = np.array([i is not None for i in ids], np.uint8)
            doc = _join([
                np.array([i or 0 for i in ids], "<i8").tobytes(), known.tobytes(), _pack([len(c) for c in codes]),
                _pack_codes(number[code]), _pack(bucket), _pack([len(many)]),
            ])
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            rows = [(block, -1, doc)]
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                own = [words[i] for i in order[cuts[k] : cuts[k + 1]].tolist()]
                rows.append((block, k, zstandard.compress(_join(own), 1)))
            index.clear(), ids.clear(), codes.clear()
            made, size = made + 1, 0
            b, k, d = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], names=["block", "bucket", "data"])

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                words = split_words(text, special)
                codes.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
                ids.append(i.as_py())
                size += len(text)
                if size >= block_bytes:
                    yield close()
        if ids:
            yield close()

    return run


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tok, special = load_tokenizer(path), vocabulary(path)[1]
        table: dict[bytes, bytes] = {w.encode(): np.array([i], "<u4").tobytes() for w, i in special.items()}
        last = None
        for batch in batches:  # sorted by bucket: the table holds one bucket's words
            out = []
            for bucket, data in zip(batch.column(1).to_pylist(), batch.column(2)):
                if bucket != last:
                    table = {w.encode(): np.array([i], "<u4").tobytes() for w, i in special.items()}
                    last = bucket
                if bucket < 0:
                    out.append(data.as_py())
                    continue
                words = _part(zstandard.decompress(data.as_py()))
                new = [w for w in words if w not in table]
                for w, e in zip(new, tok.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)):
                    table[w] = np.array(e.ids, "<u4").tobytes()
                found = [table[w] for w in words]
                out.append(_join([_pack([len(x) // 4 for x in found]), _pack(np.frombuffer(b"".join(found), "<u4"))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block", "bucket", "data"])

    return run


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs values[start : start + length], one after the other."""
    total = int(lengths.sum())
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(total)
    return values[at]


@functools.lru_cache(maxsize=2)
def _pieces(path: str) -> pa.Array:
    """The id-to-piece table: the piece of id i at place i."""
    return pa.array(vocabulary(path)[0], pa.large_binary())


def _decoded(path: str, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Bytes of each run of ids: the ids joined to the id-to-piece table, pieces put together run by run."""
    joined = _pieces(path).take(pa.array(ids.astype(np.int64)))
    if not len(joined):
        return [b""] * len(starts)
    ends = np.frombuffer(joined.buffers()[1], "<i8", len(joined) + 1, joined.offset * 8)
    data = memoryview(joined.buffers()[2] or b"")
    return [bytes(data[a:z]) for a, z in zip(ends[starts].tolist(), ends[starts + lengths].tolist())]


def _assembler(path: str, emit):
    def run(key, rows):
        doc, parts = None, {}
        for bucket, data in zip(rows.column("bucket").to_pylist(), rows.column("data")):
            if bucket < 0:
                doc = _part(data.as_py())
            else:
                parts[bucket] = [_unpack(x) for x in _part(data.as_py())]
        ids, known = np.frombuffer(doc[0], "<i8"), np.frombuffer(doc[1], np.uint8)
        per_doc, bucket, many = (_unpack(doc[i]).astype(np.int64) for i in (2, 4, 5))
        code = _unpack_codes(doc[3], int(per_doc.sum()))
        once = code == 0
        code -= 1
        code[once] = many[0] + np.arange(int(once.sum()))
        order = np.argsort(bucket, kind="stable")
        keys = sorted(parts)
        lengths = np.zeros(len(bucket), np.int64)
        lengths[order] = np.concatenate([parts[k][0] for k in keys]).astype(np.int64) if keys else []
        values = np.concatenate([parts[k][1] for k in keys]) if keys else np.zeros(0, np.uint32)
        starts = np.zeros(len(bucket), np.int64)
        starts[order] = np.concatenate(([0], np.cumsum(lengths[order])[:-1])) if len(order) else []
        word_bytes = _decoded(path, values, starts, lengths)
        out, at = [], 0
        for i, k, n in zip(ids.tolist(), known.tolist(), per_doc.tolist()):
            own = code[at : at + n]
            at += n
            got = _gather(values, starts[own], lengths[own]) if n else values[:0]
            out.append((i if k else None, *emit(got, b"".join(map(word_bytes.__getitem__, own.tolist())).decode("utf-8", "replace"))))
        return out

    return run


def _distinct_word_blocks(docs: DataFrame, id_col: str, text_col: str, path: str, block_bytes: int) -> DataFrame:
    """Packed rows (block, bucket, data): documents at bucket -1, encoded words at the others."""
    n_buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, docs.count() // DOCS_PER_BUCKET))
    source = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    split = source.mapInArrow(_splitter(path, n_buckets, block_bytes), SPLIT)
    deal = F.when(F.col("bucket") < 0, F.xxhash64("block")).otherwise(F.col("bucket").cast("long"))
    return split.withColumn("deal", deal).repartition(n_buckets, "deal").sortWithinPartitions("bucket").select("block", "bucket", "data").mapInArrow(_encoder(path), SPLIT)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: id, `ids` (array of ids) and `decoded`, the text those ids decode to.

    Ids equal the tokenizers library's encode(text, add_special_tokens=False). Null and empty
    texts give no ids and an empty decoding; repeated rows and null ids pass through; an empty
    table gives an empty one; other columns are left out.
    """
    path = path or tokenizer_file()
    inner = _assembler(path, lambda ids, text: (ids.tolist(), text))

    def run(key, rows):
        i, ids, text = zip(*inner(key, rows))
        return pa.table({"id": pa.array(i, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(text, pa.string())})

    done = _distinct_word_blocks(docs, id_col, text_col, path, block_bytes).groupBy("block").applyInArrow(run, "id long, ids array<int>, decoded string")
    return done.withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """encode(), but with counts and digests in place of the ids and the decoded text."""
    path = path or tokenizer_file()

    def emit(ids, text):
        return len(ids), hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    inner = _assembler(path, emit)

    def run(key, rows):
        i, n, a, b = zip(*inner(key, rows))
        return pa.table({"doc_id": pa.array(i, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())})

    blocks = _distinct_word_blocks(docs, "doc_id", "text", path, block_bytes)
    return blocks.groupBy("block").applyInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def piece_table(spark, path: str | None = None) -> DataFrame:
    """(id, piece): one row per id of the vocabulary, a fixed table of some 50,000 short rows."""
    pieces, _ = vocabulary(path or tokenizer_file())
    return spark.createDataFrame(list(enumerate(map(bytearray, pieces))), "id int, piece binary")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text) from rows of ids by a join with the id-to-piece table, broadcast since its size is the vocabulary's.

    id_col must tell rows apart. Ids outside the vocabulary add nothing; rows without ids decode to ''.
    """
    pieces = F.broadcast(piece_table(encoded.sparkSession, path))
    key = column(id_col)
    flat = encoded.select(key, F.posexplode_outer(column(ids_col)).alias("pos", "id"))
    parts = flat.join(pieces, "id", "left").groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", F.hex("piece").alias("h"))))).alias("p"))
    return parts.select(key, F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")), "utf-8").alias("text"))
