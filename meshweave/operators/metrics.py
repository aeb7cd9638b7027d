"""Run metrics: logs, averages, pivots, derived columns, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_summary(log: DataFrame, *by: str) -> DataFrame:
    """log(item, key, val[, epoch]): sum and number of distinct keys per item (and epoch)."""
    keys = ["item", *by]
    once = log.groupBy(*keys, "key").agg(F.sum("val").alias("val"))
    return once.groupBy(*keys).agg(F.round(F.sum("val"), 6).alias("total"), F.count("*").alias("num_key"))


def mean_after_first(log: DataFrame) -> DataFrame:
    """Mean per item without the first key (key 0): warm-up does not count; one key alone gives 0."""
    once = log.groupBy("item", "key").agg(F.sum("val").alias("val"))
    late = F.when(F.col("key") > 0, F.col("val")).otherwise(0.0)
    return once.groupBy("item").agg(F.round(F.sum(late) / F.greatest(F.count("*") - 1, F.lit(1)), 6).alias("mean"))


def byte_hit_rate(log: DataFrame) -> DataFrame:
    """(feat_bytes - miss_bytes) / feat_bytes per key, from items of those names."""
    wide = log.groupBy("key").pivot("item", ["feat_bytes", "miss_bytes"]).agg(F.sum("val"))
    return wide.select("key", F.round(F.try_divide(F.col("feat_bytes") - F.col("miss_bytes"), F.col("feat_bytes")), 6).alias("hit_rate"))


def step_report(log: DataFrame, items: list[str]) -> DataFrame:
    """One line per key: the items asked for, in order, four decimals each."""
    wide = log.groupBy("key").pivot("item", items).agg(F.sum("val"))
    return wide.select("key", F.concat_ws(" | ", *[F.format_string(f"{i} %.4f", F.coalesce(F.col(i), F.lit(0.0))) for i in items]).alias("line"))


def level_report(log: DataFrame, layout: dict[int, list[str]], level: int, average: bool = False) -> DataFrame:
    """(key, level, line): for each level up to the given one, a line of its items; items without a value are 0.

    average: one row per level with key null, each item's mean over its keys without the first.
    """
    items = [i for k in sorted(layout) if k <= level for i in layout[k]]
    if average:
        once = mean_after_first(log.where(F.col("item").isin(items))).withColumn("key", F.lit(None).cast("long"))
        wide = once.groupBy("key").pivot("item", items).agg(F.first("mean"))
    else:
        wide = log.groupBy("key").pivot("item", items).agg(F.sum("val"))
    show = lambda names: F.concat_ws(" | ", *[F.format_string(f"{i} %.4f", F.coalesce(F.col(f"`{i}`"), F.lit(0.0))) for i in names])
    lines = [F.struct(F.lit(k).alias("level"), F.concat(F.lit(f"L{k} "), show(layout[k])).alias("line")) for k in sorted(layout) if k <= level]
    return wide.select("key", F.explode(F.array(*lines)).alias("l")).select("key", "l.level", "l.line") if lines else wide.limit(0).select("key", F.lit(0).alias("level"), F.lit("").alias("line"))


def count_pivot(rows: DataFrame, row: str, column: str, names: list) -> DataFrame:
    """Rows of each `row` by value of `column`; the names are given, so no job is spent on finding them."""
    return rows.groupBy(row).pivot(column, names).count()


def pivot_results(runs: DataFrame, row: str | list[str], column: str, names: list[str], value: str = "val") -> DataFrame:
    """One row per `row` (a column or several), one column per name; the names are given, so no job is spent on finding them."""
    return runs.groupBy(*([row] if isinstance(row, str) else row)).pivot(column, names).agg(F.first(value, ignorenulls=True))


def dimension_simulation(points: DataFrame, base_dim: int = 128, rows: int = 5120, store: int = 54228, keep: tuple | list = ()) -> DataFrame:
    """Feature width that a cached share stands for, and the GB a batch copies; share 0 gives null."""
    dim = F.try_divide(F.lit(float(rows * base_dim) * 100.0 / store), F.col("pct"))
    return points.select(*keep, "pct", F.round(dim, 6).alias("dim"), F.round(dim * F.col("num_input") * 4 / (1 << 30), 9).alias("copy_gb"))


def arg_max(scores: Column) -> Column:
    """Zero-based place of the first largest element."""
    return F.array_position(scores, F.array_max(scores)) - 1


def accuracy(predictions: DataFrame, scores: str = "scores", label: str = "label") -> DataFrame:
    hit = (arg_max(F.col(scores)) == F.col(label)).cast("long")
    return predictions.agg(F.sum(hit).alias("correct"), F.count("*").alias("total"), F.round(F.avg(hit), 6).alias("accuracy"))


def derive(wide: DataFrame, parts: dict[str, list[str]]) -> DataFrame:
    """wide with one summed column per entry; missing parts count 0."""
    return wide.select("*", *[F.round(sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0)), 6).alias(name) for name, cols in parts.items()])


class ConfigList:
    """Run configurations: values per key, crossed, selected and overridden as a DataFrame."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def combo(cls, spark, **values) -> ConfigList:
        """Every combination of the values."""
        df = spark.range(1).drop("id")
        for key, options in values.items():
            df = df.select("*", F.explode(F.array(*[F.lit(o) for o in options])).alias(key))
        return cls(df)

    @classmethod
    def combo_of(cls, df: DataFrame, *keys: str) -> ConfigList:
        """Every combination of the values that the columns of df hold (a few each)."""
        made = df.agg(*[F.collect_set(k).alias(k) for k in keys])
        for k in keys:
            made = made.withColumn(k, F.explode(k))
        return cls(made)

    def select(self, key: str, *options) -> ConfigList:
        return ConfigList(self.df.where(F.col(key).isin(*options)))

    def override(self, key: str, value, where: Column | None = None) -> ConfigList:
        new = F.lit(value) if where is None else F.when(where, F.lit(value)).otherwise(F.col(key))
        return ConfigList(self.df.withColumn(key, new))

    def multi_combo(self, **values) -> ConfigList:
        """This list, each row with every combination of the values in place of its own."""
        df = self.df
        for key, options in values.items():
            df = df.withColumn(key, F.explode(F.array(*[F.lit(o) for o in options])))
        return ConfigList(df)


def chrome_trace(trace: DataFrame, stages: list[str]) -> DataFrame:
    """Begin and end events, as JSON lines, of trace(item, key, begin_us, end_us); intervals without an end or begin are left out."""
    lane = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("item")), F.lit(0))
    whole = trace.where("begin_us <> 0 and end_us <> 0").select("item", "key", lane.alias("tid"), F.explode(F.array(F.struct(F.lit("B").alias("ph"), F.col("begin_us").alias("ts")), F.struct(F.lit("E").alias("ph"), F.col("end_us").alias("ts")))).alias("e"))
    event = F.struct(F.concat_ws("_", "item", "key").alias("name"), F.col("e.ph").alias("ph"), F.lit(0).alias("pid"), F.col("tid"), F.col("e.ts").alias("ts"))
    return whole.select("key", "item", F.col("e.ph").alias("ph"), F.to_json(event).alias("event"))


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """(kind, key, val) of lines such as config:key=val and test_result:key=val; other lines are left out."""
    at = lambda i: F.regexp_extract(column, r"^(config|test_result):(.+)=(.+)$", i)
    return lines.where(F.col(column).rlike(r"^(config|test_result):.+=.+$")).select(at(1).alias("kind"), at(2).alias("key"), at(3).alias("val"))


def parse_accuracy(lines: DataFrame, column: str = "value") -> DataFrame:
    """(accuracy, seconds) of lines that tell a validation accuracy and the time so far."""
    r = r"Valid Acc: ([0-9.]+)%.*Time Cost: ([0-9.]+)"
    return lines.where(F.col(column).rlike(r)).select(F.regexp_extract(column, r, 1).cast("double").alias("accuracy"), F.regexp_extract(column, r, 2).cast("double").alias("seconds"))
