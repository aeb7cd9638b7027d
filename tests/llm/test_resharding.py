"""op13: the law, the least bytes against all choices, exact slots, hard rows, and files written anew."""

import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from meshweave.llm import resharding as R

SHAPE = "doc_id long, text string, source string, old int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SHAPE)


def resharded(spark, rows, shards):
    return R.reshard(frame(spark, rows), F.col("old"), shards).collect()


def checked(rows, got, shards):
    """The law and the columns hold; returns the bytes that moved."""
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"], r["old_shard"]) for r in got) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), old) for i, t, _, old in rows
    )
    counts = [sum(r["shard"] == j for r in got) for j in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    for j in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == j) == list(range(counts[j]))
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in got)
    return sum(r["size"] for r in got if r["shard"] != r["old_shard"])


def least_bytes(rows, shards):
    """Over every choice of the shards that get one row more, the smallest rows of each crowded shard leave."""
    n, best = len(rows), None
    sizes = {i: sorted(len((t or "").encode()) + 8 for _, t, _, old in rows if old == i) for i in {r[3] for r in rows}}
    for more in itertools.combinations(range(shards), n % shards):
        room = [n // shards + (j in more) for j in range(shards)]
        moved = sum(sum(own[: max(0, len(own) - (room[i] if i < shards else 0))]) for i, own in sizes.items())
        best = moved if best is None else min(best, moved)
    return best


HARD = [(None, None, None, 0), (None, "", "a", 0), (1, "x" * 100_000, "a", 0), (2, "é𝒳", "b", 0), (2, "é𝒳", "b", 0), (3, "same", "b", 5), (4, "same", "b", 5), (5, "", None, 2)]


@pytest.mark.parametrize("shards", [1, 2, 3, 5, 11])
def test_law_and_least_bytes(spark, shards):
    rows = HARD + [(100 + i, "w" * (i * 37 % 50), "s", i * i % 4) for i in range(30)]
    assert checked(rows, resharded(spark, rows, shards), shards) == least_bytes(rows, shards)


def test_one_shard_holds_all(spark):
    rows = [(i, "t" * (i % 9), None, 3) for i in range(100)]
    assert checked(rows, resharded(spark, rows, 7), 7) == least_bytes(rows, 7)


def test_even_shards_stay(spark):
    rows = [(i, "text", None, i % 4) for i in range(20)]
    assert checked(rows, resharded(spark, rows, 4), 4) == 0


def test_repeated_rows_and_empty_table(spark):
    rows = [(7, "again", "s", 0)] * 50 + [(8, "other", "s", 1)]
    checked(rows, resharded(spark, rows, 3), 3)
    assert resharded(spark, [], 3) == []


def test_clashing_columns(spark):
    rows = [(i, f"text {i}", "s", i % 2) for i in range(9)]
    odd = frame(spark, rows).selectExpr("*", "1 AS size", "2 AS shard", "3 AS slot", "4 AS place", "5 AS row", "6 AS text_crc32")
    checked(rows, R.reshard(odd, F.col("old"), 4).collect(), 4)
    named = frame(spark, rows).withColumnRenamed("text", "a.b")
    checked(rows, R.reshard(named, F.col("old"), 4, text_col="a.b").collect(), 4)


def test_flow_prefers_what_is_cheap():
    # 0 and 1 hold four rows each, 2 holds one: one of three shards keeps no more than the others
    kept, sizes = R.kept_rows({0: 4, 1: 4, 2: 2}, R.even(10, 3), {0: 9, 1: 30})
    assert kept == {0: 3, 1: 4, 2: 2} and sizes == [3, 4, 3]
    moves = R.transfers({0: 4, 1: 4, 2: 2}, kept, sizes)
    assert [(m.old, m.first, m.rows, m.shard, m.slot) for m in moves] == [(0, 0, 3, 0, 0), (1, 0, 4, 1, 0), (2, 0, 2, 2, 0), (0, 3, 1, 2, 2)]


def test_given_capacities(spark):
    rows = [(i, "x" * i, "s", 0) for i in range(12)]
    placed, moves = R.place(R.measured(frame(spark, rows), F.col("old")), [(0, 5), (0, 4), (0, 10)])
    counts = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 5, 1: 4, 2: 3} and moves[0].rows == 5
    assert {r["doc_id"] for r in placed.where("shard = 0").collect()} == {7, 8, 9, 10, 11}  # the largest stay
    with pytest.raises(ValueError):
        R.place(R.measured(frame(spark, rows), F.col("old")), [(0, 5), (0, 4)])


def test_files_are_written_anew(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 5), "s", 0 if i < 30 else 1 + i % 3) for i in range(45)]
    folder = f"file://{tmp_path}/docs"
    frame(spark, rows).withColumnRenamed("old", "shard").write.partitionBy("shard").parquet(folder)
    told = R.rewrite(spark, folder, 4).collect()
    assert sorted(r["rows"] for r in told) == [11, 11, 11, 12]
    back = [tuple(x) for r in told for x in spark.read.parquet(r["path"]).select("doc_id", "text", "source").collect()]
    assert sorted(back) == sorted((i, t, s) for i, t, s, _ in rows)
    for r in told:
        assert spark.read.parquet(r["path"]).count() == r["rows"]
    # even folders are left as they are
    even = f"file://{tmp_path}/even"
    frame(spark, [(i, "t", "s", i % 4) for i in range(16)]).withColumnRenamed("old", "shard").write.partitionBy("shard").parquet(even)
    told = R.rewrite(spark, even, 4).collect()
    assert not any(r["rewritten"] for r in told) and all(r["path"].startswith(even + "/shard=") for r in told)
