"""Embedding near-duplicates by a robust-pruned flat graph.

Equal vectors are merged first, so a group of copies is one node with a weight. A label's nodes form
search groups of bounded size (large labels are cut at sampled centres; pairs that a cut may part
are compared in full, see _groups). In a group: nodes are put into overlapping cluster shards, each
shard's exact neighbour lists are robust-pruned, the shards' adjacency lists are united so that
every node is also listed by some it lists (or theirs), and every node runs a greedy search from the shard
medoids that goes on from all nodes in range until no new one turns up. Within a group a sample's
links between different vectors are audited against brute force; a failing search is widened up to
WIDEST, and where that does not help the group is scanned in full, so a group's work is bounded. Every
link is verified in double precision. At last the links of a sample of nodes are counted against
their whole labels, over all cuts and groups: that recall is part of the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import connected_components, spanning, stash

THRESHOLD = 0.93
GROUP = 8192
OVERLAP = 2
SHARD = 512
DEGREE = 24
CANDIDATES = 48
ALPHA = 1.2
#: Neighbours of a node that list it in turn, full lists or not: without them no way leads to some members of a dense cluster.
LISTED = 4
BEAM = 16
#: A search group's widest beam: wider ones take several times as long as the full comparison of the group, which comes next.
WIDEST = 2 * BEAM
CENTRES = 64
LEVELS = 6
AUDIT = 128
AUDIT_RECALL = 0.98
AUDIT_NODES = 512
ROWS = 256


def robust_prune(sims: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[np.ndarray]:
    """Out-neighbours of each row of a cosine matrix: nearest first, none that a kept one is alpha times nearer to."""
    n = len(sims)
    c = min(candidates, n - 1)
    if c <= 0:
        return [np.zeros(0, np.int64)] * n
    own = sims.copy()
    np.fill_diagonal(own, -np.inf)
    near = np.argpartition(-own, c - 1, axis=1)[:, :c]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(own, near, 1), axis=1, kind="stable"), 1)
    dist = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(own, near, 1)))
    alive, kept, count = np.ones((n, c), bool), np.zeros((n, c), bool), np.zeros(n, np.int64)
    for k in range(c):
        take = alive[:, k] & (count < degree)
        kept[take, k] = True
        count += take
        if k + 1 < c:
            among = np.sqrt(np.maximum(0, 2 - 2 * sims[near[:, k, None], near[:, k + 1 :]]))
            alive[:, k + 1 :] &= ~(take[:, None] & (alpha * among <= dist[:, k + 1 :]))
    return [row[k] for row, k in zip(near, kept)]


class FlatGraph:
    """A search group's nodes: unit rows, united adjacency (padded with -1) and medoids."""

    def __init__(self, x: np.ndarray, shard: int = SHARD, overlap: int = OVERLAP, seed: int = 11):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        k = max(1, -(-n * overlap // shard)) if n > shard else 1
        centres = self.x[np.random.default_rng(seed).choice(n, k, replace=False)] if k > 1 else self.x[:1]
        for _ in range(2 if k > 1 else 0):
            who = (self.x @ centres.T).argmax(1)
            for j in range(k):
                if len(own := self.x[who == j]):
                    m = own.mean(0)
                    centres[j] = m / max(np.linalg.norm(m), 1e-9)
        o = min(overlap, k)
        homes = np.argpartition(-(self.x @ centres.T), o - 1, axis=1)[:, :o]
        lists: list[set[int]] = [set() for _ in range(n)]
        kept: list[list[int]] = [[] for _ in range(n)]
        self.medoids = []
        for j in range(k):
            members = np.flatnonzero((homes == j).any(1))
            for part in np.array_split(members, max(1, -(-len(members) // (4 * shard)))):  # a crowded shard in parts
                if not len(part):
                    continue
                own = self.x[part]
                self.medoids.append(int(part[(own @ own.mean(0)).argmax()]))
                for a, near in zip(part.tolist(), robust_prune(own @ own.T)):
                    near = part[near].tolist()
                    lists[a].update(near)
                    kept[a] += near
                    for b in near:
                        if len(lists[b]) < 2 * DEGREE:
                            lists[b].add(a)
        for a, near in enumerate(kept):
            unaware = [b for b in dict.fromkeys(near) if a not in lists[b]]
            for b in sorted(unaware, key=lambda b: len(lists[b]))[: max(0, LISTED - len(set(near)) + len(unaware))]:
                if len(lists[b]) >= 3 * DEGREE:  # the middle of a cluster that all its members list: one that it lists goes between
                    b = min((c for c in lists[b] if c != a), key=lambda c: (len(lists[c]), c))
                lists[b].add(a)
        width = max(map(len, lists), default=0)
        self.adj = np.full((n, max(1, width)), -1, np.int64)
        for a, near in enumerate(lists):
            self.adj[a, : len(near)] = sorted(near)

    def search(self, queries: np.ndarray, threshold: float, beam: int = BEAM) -> list[np.ndarray]:
        """Nodes in range that each query node reaches: a beam finds the way, then the range is followed to its edge."""
        n, q = len(self.x), len(queries)
        target = self.x[queries]
        seen, sims = np.zeros((q, n), bool), np.full((q, n), -np.inf, np.float32)
        opened = np.zeros((q, n), bool)
        starts = np.asarray(self.medoids)
        sims[:, starts] = target @ self.x[starts].T
        seen[:, starts] = True
        width = min(beam, len(starts))
        edge = starts[np.argpartition(-sims[:, starts], width - 1, axis=1)[:, :width]]
        edge_sims = np.take_along_axis(sims, edge, 1)
        active = np.ones(q, bool)
        while True:
            fresh = ~np.take_along_axis(opened, edge, 1) & (edge_sims > -np.inf)
            score = np.where(fresh, edge_sims, -np.inf)
            pick = score.argmax(1)
            active &= score[np.arange(q), pick] > -np.inf
            live = np.flatnonzero(active)
            if not len(live):
                break
            node = edge[live, pick[live]]
            opened[live, node] = True
            near = self.adj[node]
            new = self._meet(target, seen, sims, live, near)
            got = np.where(new, sims[live[:, None], near], -np.inf)
            both, both_sims = np.concatenate([edge[live], near], 1), np.concatenate([edge_sims[live], got], 1)
            top = np.argpartition(-both_sims, beam - 1, axis=1)[:, :beam] if both.shape[1] > beam else np.broadcast_to(np.arange(both.shape[1]), both.shape)
            if edge.shape[1] < top.shape[1]:
                pad = top.shape[1] - edge.shape[1]
                edge = np.pad(edge, ((0, 0), (0, pad)))
                edge_sims = np.pad(edge_sims, ((0, 0), (0, pad)), constant_values=-np.inf)
            edge[live], edge_sims[live] = np.take_along_axis(both, top, 1), np.take_along_axis(both_sims, top, 1)
            # a beam full of nodes in range has arrived: what is left is to follow the range
            active[live[(edge_sims[live] >= threshold).sum(1) >= beam - 1]] = False
        near_by = threshold - 1e-5
        while True:
            who, node = np.nonzero((sims >= near_by) & ~opened)
            if not len(who):
                break
            opened[who, node] = True
            for a in range(0, len(who), 1 << 15):
                self._meet(target, seen, sims, who[a : a + (1 << 15)], self.adj[node[a : a + (1 << 15)]], once=False)
        return [np.flatnonzero(s >= near_by) for s in sims]

    def _meet(self, target, seen, sims, who: np.ndarray, near: np.ndarray, once: bool = True) -> np.ndarray:
        """Scores the neighbours (a row of near for each query in who) not seen before; tells which these are.

        once says that no query is there twice, so that no neighbour can be either.
        """
        new = (near >= 0) & ~seen[who[:, None], near]
        r, c = np.nonzero(new)
        q, what = who[r], near[r, c]
        if not once:  # several nodes of one query may share a neighbour
            q, what = np.divmod(np.unique(q * seen.shape[1] + what), seen.shape[1])
        seen[q, what] = True
        for a in range(0, len(q), 1 << 17):
            z = slice(a, a + (1 << 17))
            sims[q[z], what[z]] = np.einsum("ij,ij->i", target[q[z]], self.x[what[z]])
        return new


def group_links(x: np.ndarray, threshold: float = THRESHOLD, beam: int = BEAM):
    """Blocks (i, j) of verified links between rows of x, each unordered pair in both directions, and the audited recall."""
    n = len(x)
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    unit = x / norms[:, None]
    graph = FlatGraph(unit)
    # nodes in random order until they have AUDIT links to others, or all of them
    order, truth, want = np.random.default_rng(17).permutation(n), [], 0
    for s in range(0, n, AUDIT):
        q = order[s : s + AUDIT]
        r, c = np.nonzero(unit[q] @ unit.T >= threshold - 1e-9)
        other = q[r] != c
        low, high = _verified(x, norms, q[r[other]], c[other], threshold)
        truth.append(low * n + high)
        want += len(low)
        if want >= AUDIT:
            break
    true, exact = np.concatenate(truth), False
    while True:
        pairs = [np.zeros(0, np.int64)]
        for a in range(0, n, ROWS):
            q = np.arange(a, min(n, a + ROWS))
            if exact:
                i, j = np.nonzero(unit[q] @ unit.T >= threshold - 1e-9)
                i = q[i]
            else:
                got = graph.search(q, threshold, beam)
                i = np.repeat(q, [len(g) for g in got])
                j = np.concatenate(got)
            fine = i != j
            low, high = _verified(x, norms, i[fine], j[fine], threshold)
            pairs.append(low * n + high)
        code = np.unique(np.concatenate(pairs))
        # a link is found if either end finds it
        recall = 1.0 if exact or not want else float(np.isin(true, code).mean())
        if recall >= AUDIT_RECALL:
            return code // n, code % n, recall
        exact = beam >= min(n, WIDEST)  # not found by the widest beam either: every pair is compared
        beam *= 2


def between_links(x: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD):
    """Blocks (i, j) of all links between rows a and rows b of x, by full comparison."""
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    unit = x / norms[:, None]
    for s in range(0, len(a), ROWS):
        q = a[s : s + ROWS]
        r, c = np.nonzero(unit[q] @ unit[b].T >= threshold - 1e-9)
        yield _verified(x, norms, q[r], b[c], threshold)


def _verified(x: np.ndarray, norms: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs, lower row first, whose cosine in double precision is in range."""
    low, high = np.minimum(i, j), np.maximum(i, j)
    keep = np.zeros(len(i), bool)
    for s in range(0, len(i), 1 << 16):
        z = slice(s, s + (1 << 16))
        keep[z] = np.einsum("ij,ij->i", x[low[z]], x[high[z]]) / (norms[low[z]] * norms[high[z]]) >= threshold
    return low[keep], high[keep]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, group: int = GROUP) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept, and the audited recall.

    audited_recall is the smaller of the search group's own audit and the recall of some AUDIT_NODES
    nodes whose links were counted against all of their labels; it is null where no vector is valid.

    Vectors link within one non-null label. Null, empty, zero and non-finite vectors, those with null
    components and rows of a null label or id link with nothing: n_links 0, component their own id.
    Repeated rows link with each other like other copies. Other columns are left out.
    """
    x = F.col("v")
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0), F.lit(False))
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    base = base.withColumn("valid", fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).withColumn("hash", F.when(F.col("valid"), F.sha2(F.to_json(F.struct("label", "v")), 256)))
    nodes = base.where("valid").groupBy("label", "hash").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    nodes = stash(nodes.withColumn("dim", F.size("v")), "vec-nodes")
    run = _group_runner(threshold)
    shape = "rep long, links long, root long, recall double"
    found = stash(_groups(nodes, group, threshold).groupBy("label", "dim", "part", "chunk").applyInArrow(run, shape), "vec-links")
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"), F.min("recall").alias("recall"))
    roots = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vec-cc")
    over_all = _recall(nodes, counted, threshold)
    named = nodes.select("hash", "rep", "n").join(counted, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("hash", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"), F.least(F.coalesce("recall", F.lit(1.0)), F.lit(over_all)).alias("recall"))
    linked = base.where("valid").select("vec_id", "hash").join(named, "hash").select("vec_id", "n_links", "component_id", "recall")
    alone = base.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("double").alias("recall"))
    every = linked.unionAll(alone)
    return every.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), F.col("recall").alias("audited_recall"))


def _recall(nodes: DataFrame, counted: DataFrame, threshold: float, sample: int = AUDIT_NODES) -> float:
    """Share of the true links of about `sample` nodes (those of the smallest digests) that were found.

    The sampled nodes go to all nodes of their label and dimension: brute force over whole labels,
    whatever parted them into groups. Links to copies are none of the search's and not counted.
    """
    share = sample / max(1, nodes.count())
    digest = F.conv(F.substring("hash", 1, 12), 16, 10).cast("double")
    picked = nodes.where(digest < share * 16.0**12).select("label", "dim", "hash", "rep", "v").collect()
    asked: dict[tuple, list] = {}
    for r in picked:
        asked.setdefault((r["label"], r["dim"]), []).append(r)
    held = {k: ([r["hash"] for r in rows], np.array([r["rep"] for r in rows], np.int64), _unit(np.array([r["v"] for r in rows], np.float64))) for k, rows in asked.items()}

    def run(batches):
        for b in batches:
            label, dim = b.column("label").to_pylist(), b.column("dim").to_numpy()
            of: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(label, dim.tolist())):
                if k in held:
                    of.setdefault(k, []).append(i)
            for k, at in of.items():
                hashes, reps, w = held[k]
                own = b.take(pa.array(at))
                x = _unit(own.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(at), k[1]))
                near = (x @ w.T >= threshold) & (np.array(own.column("hash").to_pylist())[:, None] != np.array(hashes)[None])
                yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(own.column("n").to_numpy() @ near)], names=["asker", "n"])

    truth = nodes.select("label", "dim", "hash", "n", "v").mapInArrow(run, "asker long, n long").groupBy("asker").agg(F.sum("n").alias("true_links"))
    both = truth.join(counted.select(F.col("rep").alias("asker"), "links"), "asker", "left")
    row = both.agg(F.sum(F.least("true_links", F.coalesce("links", F.lit(0)))), F.sum("true_links")).first()
    return 1.0 if not row[1] else row[0] / row[1]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components near one: exact, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if x.size else x


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _groups(nodes: DataFrame, group: int, threshold: float) -> DataFrame:
    """Nodes by search group: (label, dim, part, chunk, rep, n, v, home); every pair in range meets in exactly one.

    Each node is at home in one part. Parts above `group` nodes are cut again and again at up to
    CENTRES sampled centres: a node is at home with its nearest centre, and a visitor of each earlier
    cell that the threshold's angle can reach from it: cos to the own centre e less cos to the cell's
    centre c is at most sin(angle) |c - e|, as a node at home there is at least as near to c as to e.
    Visitors of a part go on to all cells in reach. What LEVELS cuts cannot separate is dealt out by
    hash, every node visiting all earlier buckets. Homes of a part meet in chunk 0; visitors meet the
    homes in further chunks of bounded size, and never one another.
    """
    key = ["label", "dim", "part"]
    work, done = nodes.select("label", "dim", F.lit("").alias("part"), "rep", "hash", "n", "v", F.lit(True).alias("home")), []
    homes = F.sum(F.col("home").cast("long"))
    for level in range(LEVELS + 1):
        sizes = stash(work.groupBy(*key).agg(homes.alias("m"), F.count("*").alias("every")), "vec-sizes")
        small, large = sizes.where(F.col("m") <= group), sizes.where(F.col("m") > group)
        done.append(work.join(small.select(*key), key))
        if large.isEmpty():
            break
        rows = work.join(large, key)
        if level == LEVELS:
            k = F.ceil(F.col("m") / group)
            bucket = F.pmod(F.xxhash64("hash"), k)
            into = F.sequence(F.lit(0).cast("long"), F.when(F.col("home"), bucket).otherwise(k - 1))
            done.append(_moved(rows.withColumn("own", F.when(F.col("home"), bucket)).withColumn("c", F.explode(into))))
            break
        large = large.withColumn("k", F.least(F.lit(CENTRES), F.ceil(F.lit(2.0) * F.col("m") / group)).cast("int"))
        rows = stash(work.join(large, key), "vec-large")
        # about twice as many as wanted pass the hash; the rank only orders those few
        drawn = F.conv(F.substring(F.md5(F.concat("hash", F.lit(f":{level}"))), 1, 8), 16, 10).cast("double")
        few = rows.where(F.col("home") & (drawn < (2 * F.col("k") + 16) / F.col("m") * 4294967296.0))
        place = F.row_number().over(Window.partitionBy(*key).orderBy(drawn, "hash"))
        salts = F.ceil(F.col("every") / group)
        few = stash(few.withColumn("place", place).where("place <= k").select(*key, "every", "place", "v"), "vec-centres")
        centres = few.select(*key, F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), "place", "v")
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("hash"), salts)).select(*key, "salt", "rep", "hash", "n", "v", "home")
        shape = dealt.select(*key, "rep", "hash", "n", "v", "home", F.lit(0).cast("long").alias("own"), F.lit(0).cast("long").alias("c")).schema
        by = [*key, "salt"]
        cells = dealt.groupBy(*by).cogroup(centres.groupBy(*by)).applyInArrow(_cell_runner(threshold, to_arrow_schema(shape).empty_table()), shape)
        work = stash(_moved(cells), "vec-cut")
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    every = stash(every.select(*key, "rep", "hash", "n", "v", "home"), "vec-groups") if len(done) > 1 else every
    chunks = every.groupBy(*key).agg(F.ceil(F.sum((~F.col("home")).cast("long")) / group).alias("chunks"))
    chunk = F.when(F.col("home"), F.sequence(F.lit(0).cast("long"), F.col("chunks"))).otherwise(F.array(F.pmod(F.xxhash64("hash"), F.greatest("chunks", F.lit(1).cast("long"))) + 1))
    return every.join(chunks, key).select(*key, F.explode(chunk).alias("chunk"), "rep", "n", "v", "home")


def _moved(cells: DataFrame) -> DataFrame:
    """Rows in the part of cell c, at home where that is their own."""
    part = F.concat_ws("/", "part", F.col("c").cast("string"))
    return cells.select("label", "dim", part.alias("part"), "rep", "hash", "n", "v", (F.col("home") & (F.col("c") == F.col("own"))).alias("home"))


def _rows(t: pa.Table, dim: int) -> np.ndarray:
    """The table's vectors at unit length."""
    return _unit(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def _cell_runner(threshold: float, empty: pa.Table):
    reach = np.sqrt(1 - min(1.0, threshold) ** 2) if threshold > 0 else 1.0

    def run(key, t, centres):
        dim = key[1].as_py()
        if not len(t):
            return empty
        t = t.drop_columns(["salt"])
        unit, at = _rows(t, dim), np.zeros((1, dim))
        if len(centres):  # a part without a centre stays whole
            at = _rows(centres.sort_by("place"), dim)
        sims, far = unit @ at.T, np.linalg.norm(at[:, None] - at[None], axis=2)
        own, home = sims.argmax(1), t.column("home").to_numpy(zero_copy_only=False)
        near = np.take_along_axis(sims, own[:, None], 1) - sims <= reach * far[own] + 1e-6
        near &= ~home[:, None] | (np.arange(len(at)) <= own[:, None])
        i, c = np.nonzero(near)
        return t.take(pa.array(i)).append_column("own", pa.array(own[i])).append_column("c", pa.array(c))

    return run


def _group_runner(threshold: float):
    def run(key, t):
        t = t.sort_by("rep")
        rep, n, home = (t.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "n", "home"))
        x = scaled(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, key[1].as_py()))
        links, root, recall, tree = np.zeros(len(rep), np.int64), rep.copy(), None, []
        if key[3].as_py() == 0:
            a, b, recall = group_links(x, threshold)
            blocks = [(a, b)]
        else:
            blocks = between_links(x, np.flatnonzero(home), np.flatnonzero(~home), threshold)
        for a, b in blocks:
            np.add.at(links, a, n[b])
            np.add.at(links, b, n[a])
            tree.append(spanning(a, b, np.arange(len(rep))))
        x1, x2 = spanning(*map(np.concatenate, zip(*tree)), np.arange(len(rep))) if tree else ([], [])
        root[x1] = rep[x2]
        return pa.table({"rep": pa.array(rep), "links": pa.array(links), "root": pa.array(root), "recall": pa.array(np.full(len(rep), recall, float) if recall is not None else [None] * len(rep), pa.float64())})

    return run
