"""Message passing over blocks: forward aggregations as joins and grouped sums.

edges are (src, dst[, w]); features are (node_id, feat), all of one width. A vector is summed by one
aggregate per component, so an edge is one row and partial sums combine before the shuffle; beyond
WIDE components, rows of one component each are summed instead. Where edges are of many batches, by
names the columns that tell these apart: each batch is a graph of its own, and the output keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Components up to which a vector's aggregates fit one generated method or a few.
WIDE = 256


def _aggregated(edges: DataFrame, feats: DataFrame, by: Sequence[str], one: Callable[[Column], Column], *more: str) -> DataFrame:
    """(*by, node_id, out): one(x) is the aggregate of a component x over the in-edges of each node."""
    met = edges.join(feats.select(F.col("node_id").alias("src"), "feat"), "src").select(*by, "dst", *more, "feat")
    first = feats.select(F.size("feat")).first()
    dim = first[0] if first else 0
    if dim <= WIDE:
        parts = met.groupBy(*by, F.col("dst").alias("node_id")).agg(*[one(F.col("feat")[i].cast("double")).alias(f"x{i}") for i in range(dim)])
        return parts.select(*by, "node_id", F.array(*[F.col(f"x{i}") for i in range(dim)]).cast("array<double>").alias("out"))
    rows = met.select(*by, "dst", *more, F.posexplode("feat").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    parts = rows.groupBy(*by, "dst", "dim").agg(one(F.col("x")).alias("x"))
    listed = parts.groupBy(*by, "dst").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("l"))
    return listed.select(*by, F.col("dst").alias("node_id"), F.transform("l", lambda s: s["x"]).alias("out"))


def _inverse_root(degree: Column) -> Column:
    return F.when(degree > 0, F.pow(degree, F.lit(-0.5))).otherwise(0.0)


def gcn(edges: DataFrame, feats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of neighbours' features, normalised by the root of both ends' degrees within the edges."""
    out = edges.groupBy(*by, "src").agg(F.count("*").alias("od"))
    ins = edges.groupBy(*by, "dst").agg(F.count("*").alias("id"))
    normed = edges.select(*by, "src", "dst").join(out, [*by, "src"]).join(ins, [*by, "dst"]).withColumn("n", _inverse_root(F.col("od")) * _inverse_root(F.col("id")))
    return _aggregated(normed, feats, by, lambda x: F.round(F.sum(x * F.col("n")), 6), "n")


def sage_mean(edges: DataFrame, feats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of neighbours' features."""
    return _aggregated(edges, feats, by, lambda x: F.round(F.avg(x), 6))


def pin_sage(edges: DataFrame, feats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Own features and the weighted neighbour mean, one after the other, at unit length (zero stays zero)."""
    mean = _aggregated(edges, feats, by, lambda x: F.sum(x * F.col("w")) / F.greatest(F.sum("w").cast("double"), F.lit(1.0)), "w")
    own = feats.select("node_id", F.transform("feat", lambda x: x.cast("double")).alias("own"))
    joined = mean.join(own, "node_id").select(*by, "node_id", F.concat("own", "out").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    # the norm as the one element of an array: it is found once a row, not once a component
    scaled = F.transform(F.array(F.when(norm == 0, 1.0).otherwise(norm)), lambda n: F.transform("v", lambda x: F.round(x / n, 6)))
    return joined.select(*by, "node_id", scaled[0].alias("out"))


def attention(edges: DataFrame, feats: DataFrame, scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Neighbours' features weighted by the softmax of leaky scores over each node's list.

    scores is (node_id, left, right); where these are arrays, one entry per head, the output is the
    heads' vectors one after the other.
    """
    heads = scores.select(F.size("left")).first() if scores.schema["left"].dataType.typeName() == "array" else None
    if heads is None:
        return _one_head(edges, feats, scores, by)
    outs = None
    for h in range(heads[0]):
        own = scores.select("node_id", F.col("left")[h].alias("left"), F.col("right")[h].alias("right"))
        out = _one_head(edges, feats, own, by).withColumnRenamed("out", f"out{h}")
        outs = out if outs is None else outs.join(out, [*by, "node_id"])
    return outs.select(*by, "node_id", F.concat(*[f"out{h}" for h in range(heads[0])]).alias("out"))


def _one_head(edges: DataFrame, feats: DataFrame, scores: DataFrame, by: Sequence[str]) -> DataFrame:
    left = scores.select(F.col("node_id").alias("src"), "left")
    right = scores.select(F.col("node_id").alias("dst"), "right")
    raw = edges.select(*by, "src", "dst").join(left, "src").join(right, "dst").withColumn("s", F.col("left") + F.col("right"))
    raw = raw.withColumn("s", F.when(F.col("s") > 0, F.col("s")).otherwise(F.col("s") * 0.2))
    top = raw.groupBy(*by, "dst").agg(F.max("s").alias("top"))
    raw = raw.join(top, [*by, "dst"]).withColumn("e", F.exp(F.col("s") - F.col("top")))
    total = raw.groupBy(*by, "dst").agg(F.sum("e").alias("total"))
    weighed = raw.join(total, [*by, "dst"]).select(*by, "src", "dst", (F.col("e") / F.col("total")).alias("n"))
    return _aggregated(weighed, feats, by, lambda x: F.round(F.sum(x * F.col("n")), 6), "n")


def dense(rows: DataFrame, weight: list[list[float]], bias: list[float], column: str = "out", relu: bool = False) -> DataFrame:
    """A small constant layer applied to a vector column."""
    def unit(w, b):
        y = F.aggregate(F.zip_with(F.col(column), F.array(*map(F.lit, w)), lambda x, c: x * c), F.lit(float(b)), lambda a, x: a + x)
        return F.greatest(y, F.lit(0.0)) if relu else y

    return rows.withColumn(column, F.array(*[unit(w, b) for w, b in zip(weight, bias)]))


def segment_softmax(rows: DataFrame, by: str, value: str, into: str = "p") -> DataFrame:
    w = Window.partitionBy(by)
    e = F.exp(F.col(value) - F.max(value).over(w))
    return rows.withColumn("__e", e).withColumn(into, F.col("__e") / F.sum("__e").over(w)).drop("__e")
