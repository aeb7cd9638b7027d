"""Lengths of lists told with their running sums."""

from pyspark.sql import functions as F

from meshweave.functions.ranks import running_sums


def test_sums_of_whole_lists(spark):
    """A list's length comes with its running sums, range by range, without another pass over the rows."""
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    got = running_sums(rows, "k", [F.col("id").asc()], {"n": "pos"}, pos=F.lit(1).cast("long")).collect()
    assert all(r["n"] == (167 if r["k"] < 2 else 166) and r["pos"] == r["id"] // 3 + 1 for r in got) and len(got) == 500
