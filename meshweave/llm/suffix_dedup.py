"""Removal of long repeated strings by sparse suffix arrays, sorted deep-shallow.

Every window of `length` bytes names one anchor, its smallest 100-byte gram, so equal windows name
equal anchors at equal places and only suffixes at anchors (some two in a hundred) need sorting.
Anchors with their whole surroundings equal are settled by counting. Where an anchor recurs with
different surroundings, the suffixes to its right and the reversed prefixes to its left are sorted:
multikey quicksort down to a shallow depth, blind tries for what still agrees there. The common
prefix lengths of the sorted order say which windows occur twice.

Gram hashes only choose who meets. That surroundings, windows or whole texts are equal is decided by
their bytes or by 128 bits of a cryptographic hash of them (BLAKE2b; SHA-256 for whole texts).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, stash

LENGTH = 200
SHALLOW = 32
FEW = 8
HOT = 2048
HOT_ROWS = 100_000
SAMPLE = 64
#: A window's rows meet by digest and by one of so many salts: one for each SALT surroundings of its gram, MOST_SALTS if these were not counted.
SALT, MOST_SALTS = 256, 64
CHUNK = 1 << 18
COMBINE = 8 << 20
COVERED, ANCHOR, CONTEXT, CROWDED = 0, 1, 2, 3

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
ROWS = "kind int, key long, ctx binary, uid binary, lo int, hi int, lead int, many boolean, salts int"
NAMES = ["kind", "key", "ctx", "uid", "lo", "hi", "lead", "many", "salts"]


# ---------------------------------------------------------------- deep-shallow sorting


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _byte(text: bytes, place: int) -> int:
    return text[place] if place < len(text) else -1


def _blind_trie(items: list[int], texts: list[bytes]) -> list[int]:
    """Order of differing texts. Nodes are (place, {byte or -1 at an end: child}), leaves are items."""
    root: object = items[0]
    for item in items[1:]:
        text = texts[item]
        at = root
        while isinstance(at, tuple):  # blind descent: only branching bytes are looked at
            place, kids = at
            at = kids.get(_byte(text, place))
            if at is None:
                at = next(iter(kids.values()))
        split = common_prefix(text, texts[at])
        parent, key, node = None, -1, root
        while isinstance(node, tuple) and node[0] < split:
            parent, key = node, _byte(text, node[0])
            node = node[1][key]
        if isinstance(node, tuple) and node[0] == split:
            node[1][_byte(text, split)] = item
            continue
        new = (split, {_byte(texts[at], split): node, _byte(text, split): item})
        if parent is None:
            root = new
        else:
            parent[1][key] = new
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
        else:
            out.append(node)
    return out


def deep_shallow_sort(texts: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """(order, lcp): the sorted order and each text's common prefix with the one before it."""
    equal: dict[bytes, list[int]] = {}
    for i, t in enumerate(texts):
        equal.setdefault(t, []).append(i)
    unique = list(equal)
    order: list[int] = []
    stack = [(list(range(len(unique))), 0)]
    while stack:
        items, depth = stack.pop()
        if len(items) < 2:
            order += items
            continue
        if depth >= shallow:
            order += _blind_trie(items, unique)
            continue
        words = {i: unique[i][depth : depth + 8] for i in items}
        pivot = words[items[len(items) // 2]]
        same = [i for i in items if words[i] == pivot]
        ended = [i for i in same if len(unique[i]) <= depth + 8]  # one at most: texts differ
        stack.append(([i for i in items if words[i] > pivot], depth))
        stack.append(([i for i in same if len(unique[i]) > depth + 8], depth + 8))
        stack.append((ended, depth))
        stack.append(([i for i in items if words[i] < pivot], depth))
    out = [i for u in order for i in equal[unique[u]]]
    return out, [0, *(common_prefix(texts[a], texts[b]) for a, b in zip(out, out[1:]))][: len(out)]


def repeated_windows(left: list[bytes], right: list[bytes], first: list[int], last: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each member of an anchor's group, ranges of a for which its window is another's too.

    A window starts a bytes before the anchor: left holds the reversed bytes before it, right those
    from it on; first..last are the a that the member answers for.
    """
    m = len(left)
    lo, ll = deep_shallow_sort(left)
    ro, rl = deep_shallow_sort(right)
    found: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    if m <= FEW:
        at_left, at_right = {i: k for k, i in enumerate(lo)}, {i: k for k, i in enumerate(ro)}
        for i in range(m):
            for j in range(i):
                x, y = sorted((at_left[i], at_left[j]))
                u, v = sorted((at_right[i], at_right[j]))
                a = max(first[i], first[j], length - min(rl[u + 1 : v + 1]))
                z = min(last[i], last[j], min(ll[x + 1 : y + 1]))
                if a <= z:
                    found[i].append((a, z))
                    found[j].append((a, z))
        return found
    lo, ro, ll, rl, begin, end = map(np.asarray, (lo, ro, ll, rl, first, last))
    for a in range(int(begin.min()), int(end.max()) + 1):
        left_class, right_class = np.empty(m, np.int64), np.empty(m, np.int64)
        left_class[lo] = np.cumsum(ll < a)
        right_class[ro] = np.cumsum(rl < length - a)
        own = np.flatnonzero((begin <= a) & (a <= end))
        _, at, count = np.unique(left_class[own] * (m + 1) + right_class[own], return_inverse=True, return_counts=True)
        for i in own[count[at] > 1].tolist():
            if found[i] and found[i][-1][1] == a - 1:
                found[i][-1] = (found[i][-1][0], a)
            else:
                found[i].append((a, a))
    return found


# ---------------------------------------------------------------- anchors


def gram_length(length: int, gram: int | None = None) -> int:
    """Bytes of the gram that names a window: half of it if not given, and never more than all of it."""
    gram = max(1, length // 2) if gram is None else gram
    if not 1 <= gram <= length:
        raise ValueError(f"a gram of {gram} bytes does not lie in a string of {length}")
    return gram


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Scanner:
    """Anchors of a buffer of concatenated texts; holds the power tables for one buffer size."""

    def __init__(self, length: int = LENGTH, gram: int | None = None):
        self.length, self.gram = length, gram_length(length, gram)
        self.span = length - self.gram + 1
        self.tag = max(1, (self.span - 1).bit_length())  # low bits of a gram's hash that hold its place instead
        self.size = 0
        self.letter = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _powers(self, n: int) -> None:
        if n > self.size:
            self.size = n
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (_BASE, _INVERSE))

    @staticmethod
    def _mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def anchors(self, texts: list[bytes]):
        """(which text, first window, last window, anchor's place after the first, key, surroundings' digest)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        raw = np.frombuffer(b"".join(texts), np.uint8)
        n, w, g = len(raw), self.span, self.gram
        if n < self.length:
            return self._nothing()
        self._powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.letter[raw] * self.up[:n], out=total[1:])
        grams = self._mix((total[g:] - total[:-g]) * self.down[: n - g + 1])
        k = len(grams)
        blocks = -(-k // w)
        tagged = np.full(blocks * w, _M64, np.uint64)
        tag, low = np.uint64(self.tag), np.uint64((1 << self.tag) - 1)
        tagged[:k] = (grams & ~low) | (np.arange(k) % w).astype(np.uint64)
        tagged = tagged.reshape(blocks, w)
        ahead = np.minimum.accumulate(tagged, axis=1).ravel()
        behind = np.minimum.accumulate(tagged[:, ::-1], axis=1)[:, ::-1].ravel()
        ok = np.zeros(n + 1, np.int64)
        long = sizes >= self.length
        np.add.at(ok, starts[long], 1)
        np.add.at(ok, starts[long] + sizes[long] - self.length + 1, -1)
        s = np.flatnonzero(np.cumsum(ok)[:n])
        if not len(s):
            return self._nothing()
        one, two = behind[s], ahead[s + w - 1]
        early = (one >> tag) <= (two >> tag)
        place = np.where(early, s // w * w + (one & low).astype(np.int64), (s + w - 1) // w * w + (two & low).astype(np.int64))
        doc = np.searchsorted(starts, s, side="right") - 1
        cut = np.concatenate(([0], np.flatnonzero((np.diff(place) != 0) | (np.diff(doc) != 0)) + 1))
        end = np.concatenate((cut[1:], [len(s)])) - 1
        first, last, at, which = s[cut], s[end], place[cut], doc[cut]
        view = memoryview(raw)
        around = np.frombuffer(b"".join(digest(view[a:z]) for a, z in zip(first.tolist(), (last + self.length).tolist())), "V16")
        return which, first - starts[which], last - starts[which], at - first, grams[at].view(np.int64), around

    @staticmethod
    def _nothing():
        return (*(np.zeros(0, np.int64),) * 5, np.zeros(0, "V16"))


def merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges, sorted; touching ones become one."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate(([True], lo[1:] > hi[:-1]))
    return lo[new], hi[np.concatenate((np.flatnonzero(new)[1:], [len(lo)])) - 1]


def _batch(kind, key, ctx, uid, lo, hi, lead, many, salts=1) -> pa.RecordBatch:
    n = len(lo)
    full = lambda x, t: pa.array(np.full(n, x) if np.isscalar(x) else x, t)
    ctx = pa.nulls(n, pa.binary()) if ctx is None else pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n, [None, pa.py_buffer(ctx.tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([full(kind, pa.int32()), full(key, pa.int64()), ctx, pa.array(uid, pa.binary()), full(lo, pa.int32()), full(hi, pa.int32()), full(lead, pa.int32()), full(many, pa.bool_()), full(salts, pa.int32())], names=NAMES)


def _covered(uid: list[bytes], lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return _batch(COVERED, 0, None, uid, lo, hi, 0, False)


def _scan(length: int, gram: int | None):
    """Anchor rows of each text once per task; surroundings met twice in a batch are settled there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, seen = Scanner(length, gram), set()
        uids: list[bytes] = []
        parts: list[tuple] = []
        texts: list[bytes] = []
        size = total = 0

        def flush() -> None:
            nonlocal size
            which, *rest = scanner.anchors(texts)
            parts.append((which + len(uids) - len(texts), *rest))
            texts.clear()
            size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal total
            if texts:
                flush()
            if parts:
                yield from _combined(uids, parts, length)
            uids.clear(), parts.clear()
            total = 0

        for b in batches:
            for uid, text in zip(b.column(0).to_pylist(), b.column(1)):
                if uid in seen:
                    continue
                seen.add(uid)
                raw = text.as_py() or b""
                if len(raw) >= length:
                    uids.append(uid)
                    texts.append(raw)
                    size += len(raw)
                    total += len(raw)
                    if size >= CHUNK:
                        flush()
                    if total >= COMBINE:
                        yield from emit()
        yield from emit()

    return run


def _words(digests: bytes) -> np.ndarray:
    """Digests of 16 bytes, one after the other, as pairs of whole numbers."""
    return np.frombuffer(digests, "<u8").reshape(-1, 2)


def _of_column(t: pa.Table, name: str) -> np.ndarray:
    """_words of a binary column whose values have 16 bytes each."""
    col = pa.concat_arrays([c.cast(pa.binary(16)) for c in t.column(name).chunks])
    return np.frombuffer(col.buffers()[1], "<u8", 2 * len(col), 16 * col.offset).reshape(-1, 2)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted run of rows begins: some column (of one or two dimensions) differs from the row before."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        d = c[1:] != c[:-1]
        change[1:] |= d.any(1) if d.ndim > 1 else d
    return change


def _combined(uids: list[bytes], parts: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    """One anchor row per key and surroundings, and the ranges that surroundings met twice cover."""
    which, lo, hi, lead, key, ctx = (np.concatenate(x) for x in zip(*parts))
    if not len(key):
        return
    words = _words(ctx.tobytes())
    order = np.lexsort((lo, which, *words.T, key))
    new = _starts(key[order], words[order])
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1
    keep = order[new]
    yield _batch(ANCHOR, key[keep], ctx[keep], [uids[i] for i in which[keep].tolist()], lo[keep], hi[keep], lead[keep], many[new])
    dup = order[many]
    if len(dup):
        shift = int(hi.max() + length + 1)
        a, z = merge(which[dup] * shift + lo[dup], which[dup] * shift + hi[dup] + length)
        owner = a // shift
        yield _covered([uids[i] for i in owner.tolist()], a - owner * shift, z - owner * shift)


def _settle(length: int, hot: int, hot_rows: int):
    """Anchors sorted by key and surroundings: equal surroundings are covered, differing ones go on."""

    def work(t: pa.Table, crowded: bool):
        key, lo = (t.column(c).to_numpy() for c in ("key", "lo"))
        ctx, uid = _of_column(t, "ctx"), _of_column(t, "uid")
        once = _starts(key, ctx, uid, lo)  # a text read by several tasks counts once
        t, key, ctx = t.filter(pa.array(once)), key[once], ctx[once]
        lo, hi, lead = (t.column(c).to_numpy() for c in ("lo", "hi", "lead"))
        uid = t.column("uid").combine_chunks()
        flag = t.column("many").to_numpy(zero_copy_only=False)
        new_key, new_ctx = _starts(key), _starts(key, ctx)
        cls, grp = np.cumsum(new_ctx) - 1, np.cumsum(new_key) - 1
        many = (np.bincount(cls) > 1) | (np.bincount(cls, flag) > 0)
        classes = np.bincount(grp[new_ctx])
        open_groups = np.bincount(grp[new_ctx], ~many) > 0
        row_many = many[cls]
        settled = np.flatnonzero(row_many)
        if len(settled):
            yield _covered(uid.take(pa.array(settled)), lo[settled], hi[settled] + length)
        go = np.flatnonzero(new_ctx & (classes[grp] > 1) & open_groups[grp]) if not crowded else np.flatnonzero(new_ctx)
        if len(go):
            size = classes[grp[go]]
            kind = np.where(crowded | (size > hot), CROWDED, CONTEXT)
            salts = np.full(len(go), MOST_SALTS) if crowded else -(-size // SALT)  # the same for all rows of a gram
            yield _batch(kind, key[go], None, uid.take(pa.array(go)), lo[go], hi[go], lead[go], row_many[go], salts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_rows, crowded = [], 0, None
        for b in batches:
            kind = b.column(0).to_numpy()
            done = np.flatnonzero(kind != ANCHOR)
            if len(done):
                yield b.take(pa.array(done))
                b = b.filter(pa.array(kind == ANCHOR))
            if not b.num_rows:
                continue
            t = pa.concat_tables([*held, pa.Table.from_batches([b])])
            key = t.column("key").to_numpy()
            tail = len(key) - int((key[::-1] == key[-1]).cumprod().sum())
            if tail:
                head = t.slice(0, tail)
                if crowded is not None:
                    own = int((head.column("key").to_numpy() == crowded).sum())
                    if own:
                        yield from work(head.slice(0, own), True)
                    head, crowded = head.slice(own), None
                if head.num_rows:
                    yield from work(head, False)
            rest = t.slice(tail)
            if rest.num_rows > hot_rows or crowded == key[-1]:
                crowded = key[-1]
                yield from work(rest, True)
                held = []
            else:
                held = [rest]
        if held:
            last = pa.concat_tables(held)
            yield from work(last, crowded is not None and last.column("key")[0].as_py() == crowded)

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the surroundings that each text was asked for."""
    import zstandard

    shape = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("uid", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32()), ("lead", pa.int32()), ("many", pa.bool_()), ("salts", pa.int32()), ("bytes", pa.binary())])
    out: list[dict] = []
    for b in batches:
        for uid, z, wanted, length in zip(*(b.column(c) for c in ("uid", "z", "wanted", "length"))):
            text, uid, length = zstandard.decompress(z.as_py()), uid.as_py(), length.as_py()
            out += [{**w, "uid": uid, "bytes": text[w["lo"] : w["hi"] + length]} for w in wanted.as_py()]
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, shape)
                out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, shape)


def _sorted_groups(length: int):
    """Groups of one anchor's differing surroundings, each by deep-shallow sorted suffixes."""

    def work(rows: list[dict]):
        if len(rows) < 2:
            return
        left = [r["bytes"][: r["lead"]][::-1] for r in rows]
        right = [r["bytes"][r["lead"] :] for r in rows]
        last = [r["lead"] for r in rows]
        first = [r["lead"] - (r["hi"] - r["lo"]) for r in rows]
        for r, ranges in zip(rows, repeated_windows(left, right, first, last, length)):
            if not r["many"]:
                p = r["lo"] + r["lead"]
                for a, z in ranges:
                    yield r["uid"], p - z, p - a + length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            out = []
            for row in b.to_pylist():
                if held and held[0]["key"] != row["key"]:
                    out += work(held)
                    held = []
                if not held or (held[-1]["uid"], held[-1]["lo"]) != (row["uid"], row["lo"]):  # copies read by several tasks
                    held.append(row)
            if out:
                u, lo, hi = zip(*out)
                yield _covered(list(u), np.array(lo), np.array(hi))
        out = list(work(held)) if held else []
        if out:
            u, lo, hi = zip(*out)
            yield _covered(list(u), np.array(lo), np.array(hi))

    return run


def _windows(length: int):
    """Each window of crowded surroundings by its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n = row["hi"] - row["lo"] + 1
                digests = [digest(row["bytes"][i : i + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([row["uid"]] * n, pa.binary()), pa.array(range(row["lo"], row["hi"] + 1), pa.int32()), pa.array([row["salts"]] * n, pa.int32())], names=["digest", "uid", "lo", "salts"])

    return run


def _texts(docs: DataFrame, text_col: str, *more: str) -> DataFrame:
    """(uid, raw, ...): a text's name is the first half of its SHA-256."""
    raw = F.coalesce(column(text_col), F.lit("")).cast("binary")
    return docs.select(F.unhex(F.substring(F.sha2(raw, 256), 1, 32)).alias("uid"), raw.alias("raw"), *[column(c).alias(f"__{i}") for i, c in enumerate(more)])


def _squeezed(texts: DataFrame, once: bool) -> DataFrame:
    """Texts compressed for a shuffle, other columns as they are; once: each text only once per task."""
    more = texts.columns[2:]
    types = "".join(f", {c} {texts.schema[c].dataType.simpleString()}" for c in more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        seen, press = set(), zstandard.ZstdCompressor(level=1)
        for b in batches:
            if once:
                keep = []
                for i, u in enumerate(b.column(0).to_pylist()):
                    if u not in seen:
                        seen.add(u)
                        keep.append(i)
                b = b.take(pa.array(keep, pa.int64()))
            z = [press.compress(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.binary()), *(b.column(i + 2) for i in range(len(more)))], names=["uid", "z", *more])

    return texts.mapInArrow(run, f"uid binary, z binary{types}")


def _crowded_keys(texts: DataFrame, length: int, gram: int | None, hot_rows: int, sample: int) -> DataFrame:
    """Anchor grams that a sample of the texts says more than hot_rows texts hold with differing surroundings.

    They only choose a way for all rows of such a gram, so a gram missed or picked in vain changes no result.
    """
    some = texts.where(F.pmod(F.xxhash64("uid"), F.lit(sample)) == 0).mapInArrow(_scan(length, gram), ROWS)
    counted = some.where(F.col("kind") == ANCHOR).groupBy("key").count().where(F.col("count") * sample > hot_rows)
    return stash(counted.select("key", F.lit(True).alias("crowded")), "suffix-crowded")


def covered_ranges(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int | None = None, hot: int = HOT, hot_rows: int = HOT_ROWS, sample: int = SAMPLE) -> DataFrame:
    """(uid, ranges): byte ranges of each distinct text covered by strings of `length` bytes that start elsewhere too.

    A gram of more than hot differing surroundings (or hot_rows rows in a task) is too much for one
    task to sort: its windows are dealt out by their digests instead, one by one, with the same result.
    """
    gram_length(length, gram)
    texts = _texts(docs, text_col)
    found = texts.mapInArrow(_scan(length, gram), ROWS)
    crowded = _crowded_keys(texts, length, gram, hot_rows, sample)
    if not crowded.isEmpty():  # rows of these grams never meet by gram: they go on by window digests
        found = found.join(crowded, "key", "left")
        apart = F.col("crowded") & (F.col("kind") == ANCHOR)
        found = found.withColumn("salts", F.when(apart, MOST_SALTS).otherwise(F.col("salts"))).withColumn("kind", F.when(apart, CROWDED).otherwise(F.col("kind"))).select(*NAMES)
    deal = F.when(F.col("kind") == ANCHOR, F.col("key")).otherwise(F.xxhash64("uid"))
    sorted_anchors = found.withColumn("deal", deal).repartition("deal").sortWithinPartitions("kind", "key", "ctx", "uid", "lo").select(*NAMES)
    settled = stash(sorted_anchors.mapInArrow(_settle(length, hot, hot_rows), ROWS), "suffix-anchors")
    wanted = settled.where(F.col("kind") != COVERED).groupBy("uid").agg(F.collect_list(F.struct("kind", "key", "lo", "hi", "lead", "many", "salts")).alias("wanted"))
    asked = _squeezed(texts.where(F.octet_length("raw") >= length), True).join(wanted, "uid").withColumn("length", F.lit(length))
    around = asked.mapInArrow(_contexts, "kind int, key long, uid binary, lo int, hi int, lead int, many boolean, salts int, bytes binary")
    around = stash(around, "suffix-contexts")
    calm = around.where(F.col("kind") == CONTEXT).repartition("key").sortWithinPartitions("key", "uid", "lo")
    ranges = [settled.where(F.col("kind") == COVERED).select("uid", "lo", "hi"), calm.mapInArrow(_sorted_groups(length), ROWS).select("uid", "lo", "hi")]
    crowd = around.where(F.col("kind") == CROWDED)
    windows = crowd.mapInArrow(_windows(length), "digest binary, uid binary, lo int, salts int")
    windows = windows.withColumn("salt", F.pmod(F.xxhash64("uid", "lo"), F.col("salts")).cast("int"))
    # a window that very many texts hold is counted and found again salt by salt
    each = windows.groupBy("digest", "salts", "salt").agg(F.min(F.struct("uid", "lo")).alias("least"), F.max(F.struct("uid", "lo")).alias("most"))
    twice = each.groupBy("digest", "salts").agg((F.min("least") != F.max("most")).alias("twice")).where("twice")
    twice = twice.select("digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    ranges.append(windows.join(twice, ["digest", "salt"]).select("uid", "lo", (F.col("lo") + length).alias("hi")))
    copies = texts.select("uid", F.octet_length("raw").alias("n")).where(F.col("n") >= length).groupBy("uid", "n").count().where("count > 1")
    ranges.append(copies.select("uid", F.lit(0).alias("lo"), F.col("n").alias("hi")))
    every = ranges[0]
    for r in ranges[1:]:
        every = every.unionAll(r)
    return every.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))


def _cut(text: bytes, ranges) -> tuple[np.ndarray, np.ndarray, bytes]:
    lo, hi = merge(np.array([r["lo"] for r in ranges], np.int64), np.array([r["hi"] for r in ranges], np.int64))
    kept = b"".join(text[a:z] for a, z in zip([0, *hi.tolist()], [*lo.tolist(), len(text)]))
    return lo, hi, kept


def _with_ranges(docs: DataFrame, text_col: str, keep: tuple[str, ...], **options) -> DataFrame:
    texts = _squeezed(_texts(docs, text_col, *keep), False)
    return texts.join(covered_ranges(docs, text_col, **options), "uid", "left")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null and empty texts have no bytes and keep the empty string; texts shorter than the length keep
    all; repeated rows remove each other if long enough; null ids pass through; an empty table gives
    an empty one; other columns are left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in batches:
            rows = []
            for z, i, ranges in zip(b.column("z"), b.column("__0").to_pylist(), b.column("ranges")):
                text = zstandard.decompress(z.as_py())
                lo, hi, kept = _cut(text, ranges.as_py() or [])
                rows.append((i, len(text), int((hi - lo).sum()), len(lo), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    source = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    joined = _with_ranges(source, "text", ("doc_id",), **options).select("__0", "z", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with covered bytes cut out of the texts; where a cut falls inside a character, what is left of it is dropped."""
    others = tuple(c for c in docs.columns if c != text_col)
    marks = [f"__{i}" for i in range(len(others))]
    joined = _with_ranges(docs, text_col, others, **options).select("z", "ranges", *marks)
    types = "".join(f", {m} {docs.schema[c].dataType.simpleString()}" for m, c in zip(marks, others))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in batches:
            kept = [_cut(zstandard.decompress(z.as_py()), r.as_py() or [])[2].decode("utf-8", "ignore") for z, r in zip(b.column(0), b.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), *b.columns[2:]], names=["text", *marks])

    cut = joined.mapInArrow(run, f"text string{types}")
    named = dict(zip(others, marks)) | {text_col: "text"}
    return cut.select(*[F.col(named[c]).alias(c) for c in docs.columns])
