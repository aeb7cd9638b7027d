"""Scalar functions: sizes, percentages, rounding, keys, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KB, MB, GB, TB = 1024.0, 1024.0**2, 1024.0**3, 1024.0**4
#: Bytes of one element of each type name.
TYPE_BYTES = {"f32": 4, "f64": 8, "f16": 2, "u8": 1, "i32": 4, "i8": 1, "i64": 8}


def readable_bytes(n: Column) -> Column:
    """Two decimals and the largest unit, up to GB, that n exceeds; see readable_bytes_to_tb."""
    x = n.cast("double")
    return (
        F.when(x > GB, F.format_string("%.2f GB", x / GB)).when(x > MB, F.format_string("%.2f MB", x / MB))
        .when(x > KB, F.format_string("%.2f KB", x / KB)).otherwise(F.format_string("%.2f Bytes", x))
    )


def readable_bytes_to_tb(n: Column) -> Column:
    """readable_bytes with TB above GB."""
    x = n.cast("double")
    return F.when(x > TB, F.format_string("%.2f TB", x / TB)).otherwise(readable_bytes(n))


def _whole(x: Column, y: Column) -> Column:
    """Whole quotient of two longs, y > 0, rounded down: no doubles, so exact over 2**53."""
    x, y = x.cast("long"), y.cast("long")
    return F.floor((x - F.pmod(x, y)).cast("decimal(20,0)") / y.cast("decimal(20,0)")).cast("long")


def percentage(x: Column) -> Column:
    return F.format_string("%.2f %%", x.cast("double") * 100)


def type_bytes(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TYPE_BYTES.items() for x in pair])
    return table[name].cast("long")


def tensor_bytes(name: Column, shape: Column) -> Column:
    return F.aggregate(shape, type_bytes(name), lambda a, d: a * d)


def round_up_div(x: Column, y: Column) -> Column:
    return _whole(x + y - 1, y)


def round_up(x: Column, y: Column) -> Column:
    return round_up_div(x, y) * y


def encode_key(epoch: Column, step: Column, steps: Column) -> Column:
    return epoch * steps + step


def decode_key(key: Column, steps: Column) -> tuple[Column, Column]:
    return _whole(key, steps), key % steps


def pack_pair(high: Column, low: Column) -> Column:
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long"))


def unpack_pair(key: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(0xFFFFFFFF))


def parse_device(text: Column) -> tuple[Column, Column]:
    """Kind and number of names such as cuda:0; no number counts as 0."""
    parts = F.split(text, ":")
    return parts[0], F.coalesce(F.try_element_at(parts, F.lit(2)).cast("long"), F.lit(0).cast("long"))


def parse_fanout(text: Column) -> Column:
    return F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.cast("int"))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss")


def env_flag(value: str | None) -> bool:
    return (value or "") in ("ON", "1")


def table_slots(n: int, scale: int = 2) -> int:
    """Power of two at least scale times the largest power of two that n reaches: partition-count hint."""
    return 1 << (max(1, n).bit_length() - 1 + scale)


def slots(n: Column, scale: int = 2) -> Column:
    """table_slots of a column."""
    bits = F.length(F.bin(F.greatest(n.cast("long"), F.lit(1).cast("long"))))
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits - 1 + scale)


def predict_nodes(seeds: int, fanouts: list[int], ceiling: int | None = None) -> int:
    """Upper bound of a frontier after the given fanouts, nearest layer last."""
    n = seeds
    for f in reversed(fanouts):
        n += n * f
    return n if ceiling is None else min(n, ceiling)


def predict_walk_edges(seeds: int, fanouts: list[int], walks: int, length: int) -> int:
    n = predict_nodes(seeds, fanouts[1:])
    return n * walks * length
