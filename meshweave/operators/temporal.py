"""Joins by time: the last row as of a moment, and moments within intervals, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import sorted_ranges


def as_of_join(left: DataFrame, right: DataFrame, by: str, time: str, *more: str, tie: Column | None = None, strict: bool = False) -> DataFrame:
    """left with the columns `more` of the last row of right of the same `by` whose time is not later (strict: earlier); nulls where there is none.

    Both sides are dealt into one set of sorted ranges of (by, time), so a key of any size fills many
    ranges. Each range is swept by itself, and only its last row of right by key goes on to
    the ranges after it. Rows of right at the same time count in the order of tie. Left rows without a key
    or a time get nulls, such rows of right match nothing.
    """
    held = F.struct(*[F.col(c) for c in more])
    none = F.lit(None)
    empty_left, empty_right = F.struct(*[none.cast(f.dataType).alias(f.name) for f in left.schema]), right.select(held.alias("r")).schema["r"].dataType
    order = tie if tie is not None else F.lit(0)
    rows = left.select(F.col(by).alias("__by"), F.col(time).alias("__time"), F.lit(1 - strict).alias("__side"), F.lit(True).alias("__asks"), F.lit(None).cast(right.select(order.alias("t")).schema["t"].dataType).alias("__tie"), F.struct(*left.columns).alias("__left"), none.cast(empty_right).alias("__right"))
    known = right.where(F.col(by).isNotNull() & F.col(time).isNotNull())
    rows = rows.unionByName(known.select(F.col(by).alias("__by"), F.col(time).alias("__time"), F.lit(int(strict)).alias("__side"), F.lit(False).alias("__asks"), order.alias("__tie"), empty_left.alias("__left"), held.alias("__right")))
    placed = sorted_ranges(rows, [F.col("__by").asc(), F.col("__time").asc(), F.col("__side").asc(), F.col("__tie").asc()])
    here = Window.partitionBy("__part", "__by").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = placed.withColumn("__found", F.last("__right", ignorenulls=True).over(here))
    ends = placed.where("NOT __asks").groupBy("__by", "__part").agg(F.max_by("__right", "__at").alias("__end"))
    # every range of a key, with or without rows of right, gets what the ranges before it end with
    parts = placed.select("__by", "__part").distinct().join(ends, ["__by", "__part"], "left")
    before = Window.partitionBy("__by").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("__by", "__part", F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    joined = swept.where("__asks").join(carried, ["__by", "__part"], "left")
    fine = F.col("__by").isNotNull() & F.col("__time").isNotNull()
    best = F.when(fine, F.coalesce("__found", "__carried"))
    return joined.select("__left.*", *[best[c].alias(c) for c in more])


def interval_join(points: DataFrame, intervals: DataFrame, by: str, time: str, start: str, end: str) -> DataFrame:
    """Each point with every interval of the same `by` that holds its time, start included, end not.

    Times are whole numbers or timestamps. They are cut into buckets as wide as the mean interval, so
    intervals lie in at most three buckets on average, however long single ones are; the join goes by
    (by, bucket), which splits a key of any size by time. Empty intervals and nulls match nothing.
    """

    def number(df: DataFrame, c: str) -> Column:
        stamp = df.schema[c].dataType.typeName().startswith("timestamp")
        return F.unix_micros(F.col(c).cast("timestamp")) if stamp else F.col(c).cast("long")

    some = intervals.where(F.col(start) < F.col(end))
    mean = some.agg(F.avg(number(some, end) - number(some, start))).first()[0]
    width = max(1, int(mean or 1))
    floor = lambda x: F.floor((x - F.pmod(x, F.lit(width))) / F.lit(width)).cast("long")
    spans = F.sequence(floor(number(some, start)), floor(number(some, end) - 1))
    cut = some.withColumn("__bucket", F.explode(spans))
    met = points.withColumn("__bucket", floor(number(points, time))).join(cut, [by, "__bucket"])
    return met.where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("__bucket")

