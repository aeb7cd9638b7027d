"""The text queries against their SQL, and the pipeline stage by stage."""

import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op4_chat", "op7_topk", "op9_secrets", "op10_vectors", "op11_divergence", "op12_negatives", "op13_resharding"])
def test_query(spark, name):
    import __spark_entry__ as entry

    assert compare(spark, connect(SF), entry.queries()[name], entry.oracle_sql()[name], SF) == ""


def test_all_are_registered():
    import __spark_entry__ as entry

    assert {f"op{n}_" for n in range(1, 14)} == {x.split("_")[0] + "_" for x in entry.queries() if x.startswith("op")} and "pipeline" in entry.queries()


def test_pipeline_stages(spark):
    import corpus_pipeline
    from meshweave.llm import quality, simhash, suffix_dedup
    from meshweave.llm.common import stash, table
    from meshweave.plans.session import ship_package

    ship_package(spark)
    docs = table(spark, SF, "documents").withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.lit(None)).otherwise(F.col("text")))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_copies", "repeats", "secrets", "packing"]
    seen = [docs]
    for name in list(stages)[:-1]:
        seen.append(stash(stages[name](spark, seen[-1], SF), f"test-{name}"))
        assert seen[-1].columns == docs.columns
    model = quality.fit(docs, table(spark, SF, "labels"))
    good = {r["doc_id"] for r in quality.score(docs, model).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in seen[1].collect()} == good
    first = {r["doc_id"] for r in simhash.components(seen[1]).where("doc_id = component_id").collect()}
    assert {r["doc_id"] for r in seen[2].collect()} == first
    whole = {r["doc_id"] for r in suffix_dedup.digests(seen[2]).where("n_bytes > n_removed").collect()}
    assert {r["doc_id"] for r in seen[3].collect()} == whole
    assert seen[4].count() == seen[3].count()
    packed = stages["packing"](spark, seen[4], SF)
    assert {r["doc_id"] for r in packed.collect()} == whole


def test_pipeline_on_hard_rows(spark):
    """Null ids and texts, repeated rows, clashing and missing columns, and an empty table."""
    import corpus_pipeline
    from meshweave.llm.common import stash, table

    good = [r["text"] for r in table(spark, SF, "documents").where("lang = 'en' and n_chars between 300 and 3000").limit(30).collect()]
    rows = [(i, t, "en", f"s{i % 5}", "d", 1) for i, t in enumerate(good)] + [(3, good[3], "en", "s3", "d", 1)] * 2 + [(None, good[4], "en", None, "d", 1), (900, None, "en", "s", "d", 1), (901, "", "en", "s", "d", 1), (902, " ", "en", "s", "d", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, digest string, uid int").repartition(3)
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stash(stage(spark, now, SF), f"hard-{name}")
            assert now.columns == docs.columns
            assert now.where("digest <> 'd' or uid <> 1").count() == 0
        ids = [r["doc_id"] for r in now.collect()]
        assert len(ids) == len(set(ids)) and None not in ids and set(ids) <= {r[0] for r in rows}
        packed = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
        assert {r["doc_id"] for r in packed} == set(ids) and bool(ids) == bool(start.count())


def test_pipeline_leaves_no_table_of_its_stages(spark):
    import corpus_pipeline
    from meshweave.plans import storage

    before = storage.mark()
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and storage.mark() - before == 2  # the last stage's input and pieces
