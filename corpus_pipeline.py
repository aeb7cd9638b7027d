"""Corpus preparation: each stage's kept rows are written and read again as the next stage's input.

Stages need the columns doc_id (a whole number or null) and text; secrets takes owners from source.
All columns are returned by every stage but the last, n_chars brought up to date where it exists.
Empty tables pass through; repeated rows are copies like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshweave.llm import packing, quality, secret_scan, simhash, suffix_dedup
from meshweave.llm.common import stash, table
from meshweave.plans.session import prepare
from meshweave.plans.storage import mark, only_last


def _with_length(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if there is such a column, as its texts are now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of at least one half), learnt from sf_dir's labels."""
    prepare(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def keep_first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the smallest doc_id; of repeated rows of that id, one."""
    prepare(spark)
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that strings of 200 bytes repeat across the corpus.

    Documents without any text then go: those emptied here, and those whose text was empty or null before.
    """
    prepare(spark)
    return _with_length(suffix_dedup.remove_repeats(docs).where(F.length("text") > 0))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with live-looking secrets masked; widely copied examples stay. Owners are in the column source."""
    prepare(spark)
    return _with_length(secret_scan.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("near_copies", keep_first_of_near_copies),
    ("repeats", cut_repeats),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Convolutions, fingerprints and tokens have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage wrote on its way is deleted once its rows are written."""
    docs, start = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
        only_last(spark, start)
    return STAGES[-1][1](spark, docs, sf_dir)
