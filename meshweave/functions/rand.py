"""Seeded randomness as a pure function of keys: the same on every engine, layout and retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*keys) -> Column:
    """Hex digest of the keys; ordering by it is a random order."""
    return F.md5(F.concat_ws(":", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]))


def u32(*keys) -> Column:
    """Uniform integer in 0..2**32-1."""
    return F.conv(F.substring(draw(*keys), 1, 8), 16, 10).cast("long")


def uniform(*keys) -> Column:
    """Uniform double strictly inside (0, 1)."""
    return (u32(*keys) + F.lit(0.5)) / F.lit(4294967296.0)
