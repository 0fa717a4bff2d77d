"""Running totals and positions over an order of any size, without one task for a whole group.

The order's leading column is cut into buckets that follow it. Totals per (group, bucket) are
few and are summed in a window of their own; a second window only orders the rows inside
a bucket. No group of rows is ever sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEX_DIGITS = 3  # of the key: 4,096 buckets


def shuffled_key(*columns: Column) -> Column:
    """A hash that puts rows in a repeatable random order: 32 hexadecimal digits."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]))


def bucket_of(key: Column, digits: int = HEX_DIGITS) -> Column:
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("int")


def running(df: DataFrame, group: list[str], key: str, order: list[str], value: str, out: str,
            digits: int = HEX_DIGITS) -> DataFrame:
    """``out``: the sum of ``value`` over the group's rows up to this one, by (key, order).

    ``key`` is a `shuffled_key` or another number in hexadecimal digits, of which the first ``digits`` make the buckets. Columns named ``__bucket`` and ``__before`` must not exist. Rows that agree
    in key and order are ordered arbitrarily.
    """
    keyed = df.withColumn("__bucket", bucket_of(F.col(key), digits))
    totals = keyed.groupBy(*group, "__bucket").agg(F.sum(value).alias("__total"))
    earlier = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"))
    same = F.col("__bucket") == F.col("__b")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inside = Window.partitionBy(*group, "__bucket").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        keyed.join(totals, same)
        .withColumn(out, F.col("__before") + F.sum(value).over(inside))
        .drop("__bucket", "__b", "__before", *[f"__g{i}" for i in range(len(group))]))
