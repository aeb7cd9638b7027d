"""Building blocks of the oracle SQL (DuckDB): the market graph, degrees, batches and samplers as CTEs."""

from __future__ import annotations

import re

SEED, BATCH, EPOCHS = 7, 64, 2


def md5(*keys) -> str:
    return f"md5(concat_ws(':', {', '.join(str(k) for k in keys)}))"


def u32(*keys) -> str:
    return f"CAST('0x' || substr({md5(*keys)}, 1, 8) AS BIGINT)"


def uniform(*keys) -> str:
    return f"(({u32(*keys)} + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE))"


CTES = {
    "size": "SELECT (SELECT count(*) FROM part) p, (SELECT count(*) FROM supplier) s, (SELECT count(*) FROM customer) c, (SELECT count(*) FROM embeddings) m",
    "pairs": "SELECT DISTINCT l_partkey a, p + l_suppkey b FROM lineitem, size UNION SELECT DISTINCT l_partkey, p + s + o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey, size",
    "edges": "SELECT CAST(a AS BIGINT) src, CAST(b AS BIGINT) dst FROM pairs UNION ALL SELECT CAST(b AS BIGINT), CAST(a AS BIGINT) FROM pairs",
    "nodes": "SELECT CAST(r.range AS BIGINT) node_id, CAST(label AS BIGINT) AS label, embedding feat FROM range((SELECT p + s + c FROM size)) r JOIN size ON true JOIN embeddings ON vec_id = r.range % m",
    "train": "SELECT CAST(p_partkey AS BIGINT) node_id FROM part WHERE p_partkey % 10 = 0",
    "ind": "SELECT dst node_id, count(*) n FROM edges GROUP BY 1",
    "outd": "SELECT src node_id, count(*) n FROM edges GROUP BY 1",
    "deg": "SELECT node_id, coalesce(ind.n, 0) in_degree, coalesce(outd.n, 0) out_degree FROM nodes LEFT JOIN ind USING (node_id) LEFT JOIN outd USING (node_id)",
    "adj": "SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 pos, count(*) OVER (PARTITION BY dst) deg FROM edges",
    "suffix": "SELECT src, dst, CASE WHEN out_degree < 10 THEN 100.0::DOUBLE ELSE 1.0::DOUBLE END w FROM edges JOIN deg ON node_id = src",
    "inverse": "SELECT src, dst, 1.0::DOUBLE / out_degree w FROM edges JOIN deg ON node_id = src",
    "prefixes": "SELECT dst, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 pos, src, w, sum(w) OVER (PARTITION BY dst ORDER BY src ROWS UNBOUNDED PRECEDING) prefix, count(*) OVER (PARTITION BY dst) deg FROM suffix",
    "steps": f"SELECT CAST((count(*) + {BATCH - 1}) // {BATCH} AS BIGINT) st FROM train",
    "shuffled": f"SELECT CAST(e AS BIGINT) epoch, node_id, row_number() OVER (PARTITION BY e ORDER BY {md5(SEED, 'e', 'node_id')}, node_id) - 1 rk FROM train, (SELECT unnest(range({EPOCHS})) e)",
    "batches": f"SELECT epoch * st + rk // {BATCH} batch_key, epoch, rk // {BATCH} step, rk % {BATCH} pos, node_id FROM shuffled, steps",
    "frontier": "SELECT batch_key, node_id, pos FROM batches WHERE epoch = 0",
    "everyone": "SELECT batch_key, node_id, pos FROM batches",
    "touch": "SELECT DISTINCT event_id // 100 batch_key, CAST(user_id AS BIGINT) node_id FROM events",
    "access": "SELECT batch_key, batch_key // 20 epoch, batch_key % 20 step, node_id FROM touch",
    "freq": "SELECT node_id, count(*) freq FROM access GROUP BY 1",
    "trail": "SELECT * FROM (SELECT lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) src, event_id dst FROM events) WHERE src IS NOT NULL",
}
NEEDS = {
    "pairs": ["size"], "edges": ["pairs"], "nodes": ["size"], "ind": ["edges"], "outd": ["edges"], "deg": ["nodes", "ind", "outd"], "adj": ["edges"],
    "suffix": ["edges", "deg"], "inverse": ["edges", "deg"], "prefixes": ["suffix"], "steps": ["train"], "shuffled": ["train"], "batches": ["shuffled", "steps"],
    "frontier": ["batches"], "everyone": ["batches"], "access": ["touch"], "freq": ["access"],
}


def khop_digest(frontier: str, fanout: int, layer: int, source: str = "edges", key: str | None = None) -> str:
    """The fanout positions of lowest keys, a digest for each position unless another key is given."""
    order = key or md5(SEED, "f.batch_key", layer, "e.dst", "e.src")
    met = f"SELECT f.batch_key, e.dst, e.src, row_number() OVER (PARTITION BY f.batch_key, e.dst ORDER BY {order}, e.src) rn FROM {source} e JOIN {frontier} f ON e.dst = f.node_id"
    return f"SELECT batch_key, dst, src FROM ({met}) WHERE rn <= {fanout}"


def khop(frontier: str, fanout: int, layer: int, places: str = "adj") -> str:
    """fanout positions of each list by Floyd's rule: of deg - fanout .. deg - 1 in turn, a draw up to it, or itself where that is taken."""
    drawn = f"list_transform(range(greatest(g.deg - {fanout}, 0), g.deg), lambda k: [{u32(SEED, 'f.batch_key', layer, 'g.dst', 'k')} % (k + 1), k])"
    taken = "list_reduce(draws, lambda a, x: list_append(a, CASE WHEN list_contains(a, x[1]) THEN x[2] ELSE x[1] END), CAST([] AS BIGINT[]))"
    asked = f"SELECT f.batch_key, g.dst, {drawn} draws FROM {frontier} f JOIN {places} g ON g.dst = f.node_id AND g.pos = 0"
    return f"SELECT t.batch_key, t.dst, a.src FROM (SELECT batch_key, dst, unnest({taken}) pos FROM ({asked})) t JOIN {places} a ON a.dst = t.dst AND a.pos = t.pos"


def with_(wanted: list[str], body: str, **more: str) -> str:
    """A query over the named CTEs, what they need, and more of its own."""
    seen: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in seen:
            seen.append(name)

    for name in wanted:
        add(name)
    if "adj" not in more and any(re.search(r"\badj\b", q) for q in more.values()):
        add("adj")
    parts = [f"{n} AS ({CTES[n]})" for n in seen] + [f"{n} AS MATERIALIZED ({q})" for n, q in more.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}"


def layered(frontier: str, fanouts: list[int]) -> dict[str, str]:
    """CTEs of a uniform multi-layer sample: l0, l1, ..., reached, ids."""
    out, known = {"k0": f"SELECT batch_key, node_id, 0 reached, pos FROM {frontier}"}, "k0"
    for i, f in enumerate(fanouts):
        out[f"l{i}"] = khop(known, f, i)
        out[f"k{i + 1}"] = f"SELECT batch_key, node_id, min(reached) reached, min(pos) pos FROM (SELECT batch_key, node_id, reached, pos FROM {known} UNION ALL SELECT batch_key, src, {i + 1}, NULL FROM l{i}) GROUP BY 1, 2"
        known = f"k{i + 1}"
    out["ids"] = f"SELECT batch_key, node_id, reached, row_number() OVER (PARTITION BY batch_key ORDER BY reached, pos NULLS LAST, node_id) - 1 local_id FROM {known}"
    return out
