"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates come from regular expressions in the JVM; their places from the lengths of what the same
expression splits. Value hashes are counted by distinct repositories and owners over the whole
corpus: a value many owners hold is a copied example, one that few hold and that looks random is
treated as live, and the repositories that hold it are where it must be replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, fresh_name, stash

#: kind: (pattern, group that holds the value, least length of that group)
KINDS = {
    "assign": (r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
ADDED = {
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*", 0, 40),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 24),
    "vendor": (r"(?:gh[oprs]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,})", 0, 15),
}
PRESENT = {"assign": r"(?i)password|passwd|secret|token|api_?key", "pem": "PRIVATE KEY-----", "jwt": "eyJ", "vendor": "gh[oprs]_|xox|k_live_"}
COPIED_OWNERS = 3
LIVE_LENGTH = 12
MASK = "[SECRET]"
RATED = ("n_live", "n_copied", "live_repos")
SPAN = "array<struct<start:bigint,no:int,end:bigint,kind:string,vstart:bigint,value:string>>"


def _of_kind(text: Column, no: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind; a place is the running length of the pieces and matches before it."""
    r = F.lit(pattern)
    whole, pieces = F.regexp_extract_all(text, r, 0), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, r, F.lit(group)) if group else whole
    steps = F.zip_with(F.slice(pieces, 1, F.size(whole)), F.arrays_zip(whole.alias("w"), values.alias("v")), lambda p, m: F.struct(F.length(p).cast("long").alias("gap"), F.length(m["w"]).cast("long").alias("n"), m["v"].alias("v")))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["n"]
        one = F.struct(start.alias("start"), F.lit(no).alias("no"), end.alias("end"), F.lit(kind).alias("kind"), (end - F.length(x["v"])).alias("vstart"), x["v"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(one).cast(SPAN))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(steps, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out")), step)["out"]
    return F.when(text.rlike(PRESENT.get(kind, pattern)), found).otherwise(F.array().cast(SPAN))


def candidates(docs: DataFrame, text_col: str = "text", into: str = "found") -> DataFrame:
    """docs with an array column of all spans, by start and then kind. Null text counts as empty."""
    text = F.coalesce(column(text_col), F.lit(""))
    every = {**KINDS, **ADDED}
    return docs.withColumn(into, F.array_sort(F.concat(*[_of_kind(text, i, k, *spec) for i, (k, spec) in enumerate(every.items())])))


def render(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(found: str, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def _hashed(found: Column) -> Column:
    """Spans with the value's digest and whether its shape could be a live credential's."""
    def shape(s):
        v = s["value"]
        mixed = (v.rlike("[0-9]")) & (v.rlike("[A-Za-z]")) & (F.size(F.array_distinct(F.split(v, ""))) >= 8)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["vstart"].alias("vstart"), F.sha2(v, 256).alias("hash"), ((F.length(v) >= LIVE_LENGTH) & mixed).alias("strong"))

    return F.transform(found, shape)


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) from rows (hash, repo, owner), each level combined map-side before its shuffle."""
    one = spans.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    two = one.groupBy("hash", "owner").agg(F.count("*").alias("n_repos"))
    return two.groupBy("hash").agg(F.sum("n_repos").alias("n_repos"), F.count("*").alias("n_owners"))


def classify(found: DataFrame) -> DataFrame:
    """(key, live, n_live, n_copied, live_repos) for each distinct key of rows (key, repo, owner, spans).

    live_repos is in how many repositories the most widespread live value of the key lies.
    """
    flat = found.where(F.size("spans") > 0).select("key", "repo", "owner", F.explode("spans").alias("s")).select("key", "repo", "owner", "s.*")
    freq = ownership(flat.select("hash", F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("owner", F.lit("")).alias("owner")))
    rated = flat.select("key", "hash", "start", "end", "vstart", "kind", "strong").distinct().join(freq, "hash")
    copied = F.col("n_owners") >= COPIED_OWNERS
    live = ~copied & F.col("strong")
    return rated.groupBy("key").agg(
        F.array_sort(F.collect_list(F.when(live, F.struct("vstart", "end", "kind")))).alias("live"),
        F.sum(live.cast("long")).alias("n_live"), F.sum(copied.cast("long")).alias("n_copied"),
        F.coalesce(F.max(F.when(live, F.col("n_repos"))), F.lit(0).cast("long")).alias("live_repos"),
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """repo, owner, spans, rendered spans and a key that only equal findings of one id share."""
    three = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"), column(owner_col).cast("string").alias("owner"))
    rows = candidates(three).select(
        "doc_id", F.col("doc_id").cast("string").alias("repo"), "owner",
        *[_count("found", k).alias(f"n_{k}") for k in KINDS],
        F.sha2(render(F.filter("found", lambda s: s["kind"].isin(*KINDS))), 256).alias("base_sha256"),
        render(F.col("found")).alias("rendered"), _hashed(F.col("found")).alias("spans"),
    )
    return rows.withColumn("key", F.sha2(F.concat_ws("|", F.coalesce("repo", F.lit("")), F.coalesce("owner", F.lit("")), "rendered", F.array_join(F.transform("spans", lambda s: s["hash"]), ",")), 256))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row per input row: counts and digest of the base kinds, all spans, and their ownership classes.

    n_live and n_copied count spans; live_repos is the number of repositories (documents, told apart
    by owner and id) that hold the most widespread of the row's live values, 0 if it has none.
    Null texts have no spans, null owners count as one owner, repeated rows give repeated rows,
    null ids stay null and an empty table gives none. Columns but the three named are left out.
    """
    found = stash(_keyed(docs, id_col, text_col, owner_col), "secrets")
    shown = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", F.col("rendered").alias("spans")]
    clean = found.where(F.size("spans") == 0).select(*shown, *[F.lit(0).cast("long").alias(c) for c in RATED])
    rated = found.where(F.size("spans") > 0).join(classify(found).select("key", *RATED), "key", "left")
    return clean.unionAll(rated.select(*shown, *RATED))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """docs with the values of live-looking secrets masked; all else, copied examples too, unchanged.

    Texts are scanned once: rows are written with their findings, those without any are read back as
    they are, and only the others meet the corpus-wide classes. Null texts stay null.
    """
    spans = fresh_name(docs.columns, "found")
    scanned = stash(candidates(docs, text_col, spans).withColumn(spans, _hashed(column(spans))), "secrets-scanned")
    clean = scanned.where(F.size(column(spans)) == 0).select(*[column(c) for c in docs.columns])
    dirty = scanned.where(F.size(column(spans)) > 0).select(
        F.struct(*[column(c) for c in docs.columns]).alias("row"), column(spans).alias("spans"),
        F.coalesce(column(id_col).cast("string"), F.lit("")).alias("repo"), F.coalesce(column(owner_col).cast("string"), F.lit("")).alias("owner"),
    )
    marks = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"], s["hash"])), ",")
    dirty = dirty.withColumn("key", F.sha2(F.concat_ws("|", "repo", "owner", marks), 256))
    rated = dirty.join(classify(dirty.select("key", "repo", "owner", "spans")).select("key", "live"), "key", "left")
    text = F.col("row").getField(text_col)

    def step(acc, s):
        cut = F.greatest(acc["at"], s["vstart"])
        ahead = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (cut - acc["at"]).cast("int")), F.lit(MASK))
        fresh = s["end"] > acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, ahead).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("live", start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    new = F.when(F.size("live") > 0, masked).otherwise(text)
    return clean.unionByName(rated.select(*[(new if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns]))
