"""NPZ containers read in byte ranges and written from part files: no array is ever whole in a process.

The driver reads a member's headers only. A stored member is a run of bytes, which tasks read by ranges;
a deflated one can only be read from its start, which one task does in chunks. An array of two
dimensions lies in lanes (rows, or columns in Fortran order): tuples along a lane are read as they lie,
tuples across lanes by reading the same range of each lane.
"""

from __future__ import annotations

import dataclasses
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.storage import delete, shared_root
from .arrays import BATCH_BYTES, SPLIT_BYTES, TYPES, _place, array_files, write_array

FORMAT = "meshweave_npz"
#: Spark type of each numpy type that is read.
KINDS = {np.dtype(t): sql for t, sql in TYPES.values() if "decimal" not in sql} | {np.dtype("<u2"): "int", np.dtype("<i2"): "short"}


@dataclasses.dataclass(frozen=True)
class Member:
    """An array inside a container: where its numbers start in the file (-1: deflated), its type, shape and order."""

    start: int
    dtype: np.dtype
    shape: tuple[int, ...]
    by_column: bool

    @property
    def tuples_along(self) -> tuple[int, int]:
        """(tuples, width) of the tuples that lie together."""
        if len(self.shape) < 2:
            return int(np.prod(self.shape)), 1
        return self.shape[::-1] if self.by_column else self.shape


def _header(f) -> tuple[np.dtype, tuple[int, ...], bool, int]:
    """Type, shape, order and length of the header that an array stream starts with."""
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, dtype = read(f)
    return dtype, shape, by_column, f.tell()


def member(path: str, name: str) -> Member:
    """What the headers of an array tell."""
    system, inside = _place(path)
    with system.open_input_file(inside) as raw, zipfile.ZipFile(raw) as z:
        names = {i.filename.removesuffix(".npy"): i for i in z.infolist()}
        if name not in names:
            raise KeyError(f"{path} has no array {name}")
        info = names[name]
        with z.open(info) as f:
            dtype, shape, by_column, size = _header(f)
        if dtype.newbyteorder("<") not in KINDS or len(shape) > 2:
            raise ValueError(f"{name} is an array of {dtype} with {len(shape)} dimensions")
        start = -1
        if info.compress_type == zipfile.ZIP_STORED:
            raw.seek(info.header_offset)
            local = raw.read(30)  # the local header: 30 bytes, of which the last four are the lengths of name and extra field
            start = info.header_offset + 30 + int.from_bytes(local[26:28], "little") + int.from_bytes(local[28:30], "little") + size
        return Member(start, dtype, shape, by_column)


@dataclasses.dataclass
class Range(InputPartition):
    first: int
    rows: int


class NpzSource(DataSource):
    """Rows (pos, value); options: path, name, across (whether tuples go across lanes), split (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        m = member(self.options["path"], self.options["name"])
        sql = KINDS[m.dtype.newbyteorder("<")]
        return f"pos long, value {f'array<{sql}>' if len(m.shape) == 2 else sql}"

    def reader(self, schema) -> NpzReader:
        return NpzReader(self.options)


class NpzReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.name, self.split = options["path"], options["name"], int(options["split"])
        self.member = member(self.path, self.name)
        self.across = options["across"] == "true" and len(self.member.shape) == 2
        along = self.member.tuples_along
        self.rows, self.width = along[::-1] if self.across else along
        self.item = self.member.dtype.itemsize

    def partitions(self) -> list[Range]:
        if self.member.start < 0:
            if self.across:
                raise ValueError(f"{self.name} is deflated: its lanes cannot be read side by side")
            return [Range(0, self.rows)]
        step = max(1, self.split // (self.item * max(1, self.width)))
        return [Range(a, min(step, self.rows - a)) for a in range(0, self.rows, step)] or [Range(0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, inside = _place(self.path)
        step = max(1, BATCH_BYTES // (self.item * max(1, self.width)))
        with system.open_input_file(inside) as raw:
            if self.member.start < 0:
                with zipfile.ZipFile(raw) as z, z.open(next(i for i in z.infolist() if i.filename.removesuffix(".npy") == self.name)) as f:
                    _header(f)
                    for a in range(0, part.rows, step):
                        n = min(step, part.rows - a)
                        yield self._batch(a, n, self._numbers(f.read(n * self.width * self.item)))
                return
            for a in range(part.first, part.first + part.rows, step):
                n = min(step, part.first + part.rows - a)
                if self.across:
                    lanes = [self._numbers(raw.read_at(n * self.item, self.member.start + (k * self.rows + a) * self.item)) for k in range(self.width)]
                    flat = np.stack(lanes, axis=1).ravel() if lanes else np.zeros(0, self.member.dtype)
                else:
                    flat = self._numbers(raw.read_at(n * self.width * self.item, self.member.start + a * self.width * self.item))
                yield self._batch(a, n, flat)

    def _numbers(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.member.dtype)

    def _batch(self, first: int, n: int, flat: np.ndarray) -> pa.RecordBatch:
        wide = {"f2": "<f4", "u1": "<i2", "u2": "<i4", "u4": "<i8"}.get(self.member.dtype.str[1:], self.member.dtype.newbyteorder("<"))
        value = pa.array(flat.astype(wide))
        if len(self.member.shape) == 2:
            value = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * self.width, pa.int32()), value)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), value], names=["pos", "value"])


def _load(spark: SparkSession, path: str, name: str, across: bool, split: int) -> DataFrame:
    spark.dataSource.register(NpzSource)
    return spark.read.format(FORMAT).options(path=path, name=name, across=str(across).lower(), split=split).load()


def read_npz(spark: SparkSession, path: str, name: str, split: int = SPLIT_BYTES) -> DataFrame:
    """(pos, value) of an array; rows of a two-dimensional one are arrays. Deflated arrays in Fortran order are an error."""
    m = member(path, name)
    return _load(spark, path, name, len(m.shape) == 2 and m.by_column, split)


def edges_from_npz(spark: SparkSession, path: str, name: str = "edge_index", split: int = SPLIT_BYTES) -> DataFrame:
    """edges(src, dst) of an array of two rows, sources and destinations.

    Both ends are read at the same ranges, so nothing is joined; a deflated array, of which one task
    reads all of the sources before the first destination, is joined by place.
    """
    m = member(path, name)
    if len(m.shape) != 2 or m.shape[0] != 2:
        raise ValueError(f"{name} is not two rows of nodes")
    end = lambda i: F.col("value")[i].cast("long")
    if m.start >= 0 or m.by_column:
        return _load(spark, path, name, not m.by_column, split).select(end(0).alias("src"), end(1).alias("dst"))
    rows = _load(spark, path, name, False, split).select("pos", F.posexplode("value").alias("at", "node"))
    side = lambda pos, to: rows.where(F.col("pos") == pos).select("at", F.col("node").cast("long").alias(to))
    return side(0, "src").join(side(1, "dst"), "at").select("src", "dst")


def write_npz(spark: SparkSession, path: str, deflate: bool = False, **arrays: tuple[DataFrame, str, tuple[int, ...]]) -> None:
    """One NPZ file of arrays given as (rows (pos, value), type name, shape), pos being the place in row order.

    Numbers are written in parallel as part files; a container is one stream of bytes, so one task
    then copies the parts into it in chunks.
    """
    folder, plan = f"{shared_root(spark)}/npz-parts-{uuid.uuid4().hex}", []
    for name, (rows, kind, shape) in arrays.items():
        write_array(rows, f"{folder}/{name}", kind)
        plan.append((name, TYPES[kind][0], shape))

    def copy(batches):
        system, inside = _place(path)
        system.create_dir(inside.rsplit("/", 1)[0], recursive=True)
        for b in batches:
            if not b.num_rows:
                continue
            with system.open_output_stream(inside) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if deflate else zipfile.ZIP_STORED) as z:
                for name, dtype, shape in plan:
                    with z.open(f"{name}.npy", "w", force_zip64=True) as f:
                        np.lib.format.write_array_header_1_0(f, {"descr": dtype, "fortran_order": False, "shape": tuple(shape)})
                        for part, _ in array_files(f"{folder}/{name}"):
                            there, at = _place(part)
                            with there.open_input_stream(at) as data:
                                while chunk := data.read(BATCH_BYTES):
                                    f.write(chunk)
            yield b

    spark.range(1).coalesce(1).mapInArrow(copy, "id long").collect()
    delete(spark, folder)
