"""File sources and sinks, scalar helpers and the stream forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.functions import scalar
from meshweave.operators import build
from meshweave.sources import files
from meshweave.streaming import access as streams

META = {k: i + 1 for i, k in enumerate(files.META_KEYS)}


def test_meta(spark, tmp_path):
    files.write_meta(spark, META, str(tmp_path / "meta"))
    assert files.read_meta(spark, str(tmp_path / "meta")) == META
    (tmp_path / "bad.txt").write_text("NUM_NODE 3\nonly\n")
    with pytest.raises(ValueError, match="NUM_EDGE"):
        files.read_meta(spark, str(tmp_path / "bad.txt"))


@pytest.mark.parametrize("kind", sorted(files.TYPES))
def test_arrays(spark, tmp_path, kind):
    a = np.arange(12).astype(files.TYPES[kind][0])
    (tmp_path / "a.bin").write_bytes(a.tobytes())
    rows = sorted(files.read_array(spark, str(tmp_path / "a.bin"), kind, 12).collect())
    assert [(int(p), float(v)) for p, v in rows] == [(i, float(i)) for i in range(12)]
    wide = sorted(files.read_array(spark, str(tmp_path / "a.bin"), kind, 4, 3).collect())
    assert [list(map(float, v)) for _, v in wide] == [[3.0 * i, 3.0 * i + 1, 3.0 * i + 2] for i in range(4)]
    with pytest.raises(ValueError):
        files.read_array(spark, str(tmp_path / "a.bin"), kind, 13)


def test_csc_and_coo(spark, tmp_path):
    edges = [(1, 0), (2, 0), (0, 2), (1, 2)]
    (tmp_path / "coo.bin").write_bytes(np.array(edges, "<u4").tobytes())
    assert sorted(map(tuple, files.read_coo(spark, str(tmp_path / "coo.bin")).collect())) == sorted(edges)
    (tmp_path / "indptr.bin").write_bytes(np.array([0, 2, 2, 4], "<u4").tobytes())
    (tmp_path / "indices.bin").write_bytes(np.array([1, 2, 0, 1], "<u4").tobytes())
    back = files.edges_from_csc(files.read_array(spark, str(tmp_path / "indptr.bin"), "u32"), files.read_array(spark, str(tmp_path / "indices.bin"), "u32"), 3)
    assert sorted(map(tuple, back.select("src", "dst").collect())) == sorted(edges)


def test_text_csv_npz_and_sinks(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1 2\n3 4\n")
    assert sorted(map(tuple, files.read_edge_text(spark, str(tmp_path / "e.txt")).collect())) == [(1, 2), (3, 4)]
    import gzip

    with gzip.open(tmp_path / "l.csv.gz", "wt") as f:
        f.write("5\n6\n")
    assert sorted(r[0] for r in files.read_csv(spark, str(tmp_path / "l.csv.gz"), "label long").collect()) == [5, 6]
    np.savez(tmp_path / "x.npz", a=np.array([7, 8]))
    assert sorted(map(tuple, files.read_npz(spark, str(tmp_path / "x.npz"), "a").collect())) == [(0, 7), (1, 8)]
    ranking = spark.createDataFrame([(0, 3), (1, 1)], "rank long, node_id long")
    for policy in ("degree", "random"):
        files.write_rankings(ranking, policy, str(tmp_path / "ranking"))
    assert spark.read.parquet(str(tmp_path / "ranking")).where("policy = 'degree'").count() == 2
    files.write_tsv(ranking, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).count() == 2
    files.write_degrees(ranking, str(tmp_path / "d"), text=True)
    files.write_bucketed(spark.createDataFrame([(1, 0), (2, 0)], "src long, dst long"), "lists", 2)
    assert build.adjacency_lists(spark.table("lists")).first()["neighbours"] == [1, 2]
    files.write_trace(spark.createDataFrame([("{}",)], "event string"), str(tmp_path / "trace"))
    assert files.warm(ranking) == 2


def test_scalars(spark):
    one = spark.range(1)
    sizes = one.select(*[scalar.readable_bytes(F.lit(n)).alias(str(n)) for n in (1024, 1025, 3 << 20, 5 << 30)]).first()
    assert list(sizes) == ["1024.00 Bytes", "1.00 KB", "3.00 MB", "5.00 GB"]
    high, low = scalar.unpack_pair(scalar.pack_pair(F.lit(7), F.lit(4294967295)))
    assert list(one.select(high, low).first()) == [7, 4294967295]
    assert scalar.env_flag("ON") and scalar.env_flag("1") and not scalar.env_flag(None)
    assert scalar.predict_nodes(10, [5, 10]) == 660 and scalar.predict_nodes(10, [5, 10], 100) == 100


def test_stream_state_equals_batch(spark, tmp_path):
    rows = [(0, 1), (0, 2), (1, 1), (2, 1), (2, 2), (4, 2)]
    for i in range(3):
        spark.createDataFrame([r for r in rows if r[0] // 2 == i], "batch_key long, node_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.read_events(spark, str(tmp_path / "in"), "batch_key long, node_id long")
    q = streams.repeats_across_batches(stream).writeStream.format("memory").queryName("repeats").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    seen = set(rows)
    assert sorted(map(tuple, spark.table("repeats").collect())) == sorted((b, n, (b - 1, n) in seen) for b, n in rows)


def test_windowed_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = streams.read_events(spark, str(tmp_path / "in"), events.schema, 8)
    q = streams.windowed_access(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, streams.windowed_access(events).collect()))


def test_written_tables_can_be_cleared(spark):
    from meshweave.plans import storage

    df = storage.materialise(spark.range(3), "t")
    path = storage._written[-1].removeprefix("file://")
    assert df.count() == 3 and __import__("os").path.isdir(path)
    assert storage.clear(spark) >= 1 and not __import__("os").path.isdir(path)
