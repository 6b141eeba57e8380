"""Keys of a stream dealt into parts. A call to Python, and a frame back from it, are for a part of keys, not for each: with
keys of a few rows these cost far more than the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a stream's keys. State is kept by part, so a checkpoint holds for this number alone.
PARTS = 256


def part(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(PARTS)).cast("int").alias("part")


def named(key: str | None) -> tuple[str]:
    """The key of a map state, which can't be null."""
    return ("" if key is None else f"={key}",)
