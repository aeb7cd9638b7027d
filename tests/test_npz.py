"""NPZ containers in ranges: stored and deflated, both orders, many splits, written from frames."""

import io

import numpy as np
import pytest

from meshweave.sources import npz


@pytest.fixture
def arrays():
    rng = np.random.default_rng(0)
    return {
        "edge_index": rng.integers(0, 10**12, (2, 5003)), "feat": rng.normal(size=(777, 5)).astype(np.float32), "flat": rng.integers(0, 255, 4001).astype(np.uint8),
        "by_column": np.asfortranarray(rng.normal(size=(300, 3))), "pairs_by_column": np.asfortranarray(rng.integers(0, 99, (2, 640)).astype(np.int32)), "none": np.zeros((0, 4)), "wide": np.array([2**32 - 1, 0], np.uint32), "big_end": np.arange(9).astype(">i4"),
    }


@pytest.mark.parametrize("split", [64, 4096, 1 << 26])
def test_stored(spark, tmp_path, arrays, split):
    path = str(tmp_path / "s.npz")
    np.savez(path, **arrays)
    for name, a in arrays.items():
        got = sorted(npz.read_npz(spark, path, name, split).collect())
        assert [r[0] for r in got] == list(range(len(a))) and [r[1] for r in got] == a.tolist(), name
    for name in ("edge_index", "pairs_by_column"):
        df = npz.edges_from_npz(spark, path, name, split)
        assert sorted(map(tuple, df.collect())) == sorted(zip(*arrays[name].tolist()))
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    if split == 4096:
        assert npz.edges_from_npz(spark, path, "edge_index", split).rdd.getNumPartitions() > 10


def test_deflated(spark, tmp_path, arrays):
    path = str(tmp_path / "d.npz")
    np.savez_compressed(path, **arrays)
    for name in ("edge_index", "feat", "flat", "none"):
        assert [r[1] for r in sorted(npz.read_npz(spark, path, name).collect())] == arrays[name].tolist()
    for name in ("edge_index", "pairs_by_column"):
        assert sorted(map(tuple, npz.edges_from_npz(spark, path, name).collect())) == sorted(zip(*arrays[name].tolist()))
    with pytest.raises(Exception, match="deflated"):
        npz.read_npz(spark, path, "by_column").collect()


@pytest.mark.parametrize("deflate", [False, True])
def test_written_from_frames(spark, tmp_path, deflate):
    rows = spark.range(1000).selectExpr("id AS pos", "id * 3 AS value").repartition(7)
    pairs = spark.range(50).selectExpr("id AS pos", "array(id / 2, -id / 4) AS value")
    path = str(tmp_path / "w.npz")
    npz.write_npz(spark, path, deflate, a=(rows, "i64", (2, 500)), b=(pairs, "f64", (50, 2)))
    with np.load(io.BytesIO(open(path, "rb").read())) as f:
        assert (f["a"].ravel() == np.arange(1000) * 3).all() and f["a"].shape == (2, 500) and f["b"].tolist() == [[i / 2, -i / 4] for i in range(50)]
    assert sorted(map(tuple, npz.edges_from_npz(spark, path, "a", 256).collect())) == [(3 * i, 1500 + 3 * i) for i in range(500)]


def test_what_is_not_read(spark, tmp_path):
    path = str(tmp_path / "b.npz")
    np.savez(path, words=np.array(["a", "b"]), cube=np.zeros((2, 2, 2)), three=np.zeros((3, 4)))
    for name, error in (("words", ValueError), ("cube", ValueError), ("gone", KeyError)):
        with pytest.raises(error):
            npz.read_npz(spark, path, name)
    with pytest.raises(ValueError):
        npz.edges_from_npz(spark, path, "three")
