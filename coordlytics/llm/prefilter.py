"""Rows that may match a list of keys, told apart before a join so that all others need no shuffle.

The keys are marked in a bitmap of bounded size, which goes to all tasks. It never misses a key; it may let others
through, so an exact join has to follow for the rows it marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
MOST_BITS = 1 << 27  # 16 MB; with more keys than that fits, more rows pass and the result is the same
BLOCK = 1 << 15  # bits in one row of Spark's bitmaps


def possible(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` whose ``key`` may be among those of ``wanted``, all others). Null keys count as equal.

    ``wanted`` is read twice: it should be a stored table. Columns ``__block`` and ``__bits`` must not exist.
    """
    size = BLOCK
    keys = wanted.count()
    while size < min(BITS_PER_KEY * keys, MOST_BITS):
        size *= 2
    bitmaps = wanted.select(_slot(wanted_key, size).alias("slot")).groupBy(
        F.bitmap_bucket_number("slot").alias("__block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("__bits"))
    slot = _slot(key, size)
    marked = df.join(F.broadcast(bitmaps), F.bitmap_bucket_number(slot) == F.col("__block"), "left")
    position = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("__bits", (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))
    return (marked.filter(hit).drop("__block", "__bits"), marked.filter(~hit).drop("__block", "__bits"))


def _slot(key: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(size)) + 1  # buckets of Spark's bitmaps count from 1
