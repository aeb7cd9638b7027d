"""Global ranks without a single-partition sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialise


def sorted_ranges(df: DataFrame, keys: list[Column]) -> DataFrame:
    """df dealt into sorted ranges of keys and written; __part is a row's range, __at its place there."""
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    placed = materialise(placed, "ranges")
    return placed.withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id")


def global_rank(df: DataFrame, order: list[Column], into: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Zero-based position in `order`, within `by` if given.

    Rows are dealt into ranges of (by, order) by sampled quantiles and sorted range by range; the
    written ranges fix each row's place in its range. What is summed in one task is the number of
    rows of each range, one row per task however many values there are. Ties in order keep any
    order of their own, so order should end in a key.
    """
    by = by or []
    placed = sorted_ranges(df, [*[F.col(c).asc() for c in by], *order])
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = placed.join(F.broadcast(starts), "__part").withColumn(into, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")
    if not by:
        return ranked
    first = ranked.groupBy(*by).agg(F.min(into).alias("__first"))
    return ranked.join(first, by).withColumn(into, F.col(into) - F.col("__first")).drop("__first")


def running_sums(df: DataFrame, by: str, order: list[Column], whole: dict[str, str] | None = None, **sums: Column) -> DataFrame:
    """df with running sums (the row itself included) within each value of by, whatever share of the rows it has.

    whole names columns for the sums over all rows of the value: {"deg": "pos"} is the last of the running sums pos.

    A value's rows may fill many ranges: each is summed by itself, and of each range only its sums by
    value go on to the next. A window over by would put all of a value's rows into one task.
    """
    tagged = df.withColumns({f"__{k}": v for k, v in sums.items()})
    placed = sorted_ranges(tagged, [F.col(by).asc(), *order])
    inside = Window.partitionBy("__part", by).orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = placed.groupBy(by, "__part").agg(*[F.sum(f"__{k}").alias(f"__all_{k}") for k in sums])
    earlier = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.sum(f"__all_{k}").over(Window.partitionBy(by)).alias(name) for name, k in (whole or {}).items()]
    starts = parts.select(by, "__part", *[F.coalesce(F.sum(f"__all_{k}").over(earlier), F.lit(0)).alias(f"__before_{k}") for k in sums], *ends)
    rows = placed.withColumns({f"__in_{k}": F.sum(f"__{k}").over(inside) for k in sums}).join(starts, [by, "__part"])
    return rows.select(*df.columns, *[(F.col(f"__in_{k}") + F.col(f"__before_{k}")).alias(k) for k in sums], *(whole or {}))


def rank_by_value(df: DataFrame, value: str, key: str, into: str = "rank") -> DataFrame:
    """Rank by (value, key), both descending."""
    return global_rank(df, [F.col(value).desc(), F.col(key).desc()], into)


def rank_by_draw(df: DataFrame, draw: Column, tie: str, into: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Rank by a hex digest, then by tie, within `by` if given.

    Digests spread evenly, so their leading three digits cut the rows into 4096 like buckets without
    a sample: one task sums the buckets' sizes, each bucket is sorted by itself.
    """
    by = by or []
    tagged = df.withColumn("__d", draw).withColumn("__b", F.substring("__d", 1, 3))
    sizes = tagged.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    here = Window.partitionBy(*by, "__b").orderBy("__d", tie)
    ranked = tagged.withColumn("__at", F.row_number().over(here).cast("long") - 1).join(starts, [*by, "__b"])
    return ranked.withColumn(into, F.col("__at") + F.col("__before")).drop("__at", "__before", "__b", "__d")
