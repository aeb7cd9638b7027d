"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own if all runs on this one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not f"{spark.sparkContext.master}[".startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="meshweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write once, read back: lineage ends here and a lost executor loses nothing."""
    path = f"{shared_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in the list of written tables, for only_last and clear."""
    return len(_written)


def only_last(spark: SparkSession, since: int) -> None:
    """Delete the tables written after a mark but the newest, once only that one is read any more."""
    if len(_written) > since:
        last = _written.pop()
        clear(spark, since)
        _written.append(last)


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables written so far (or after a mark), once no DataFrame that reads them is needed; returns how many."""
    n = len(_written) - since
    while len(_written) > since:
        delete(spark, _written.pop())
    return max(0, n)
