"""Exact discrete quantiles that neither collect a group nor sort it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from coordlytics.plans.ordered import Prefix, ordered_scan


def discrete_quantiles(
    histogram: DataFrame, by: list[str], value: str, count: str, wanted: dict[str, float]
) -> DataFrame:
    """Per group, the smallest value that at least a fraction q of the group does not exceed.

    ``histogram`` has one row per group and value with its count, which is the part of the
    work that shrinks the data; a running count over the distinct values finds the ranks. It is
    read several times here, so callers store it. Null values count for nothing.
    """
    known = histogram.filter(F.col(value).isNotNull())
    ranked = ordered_scan(known, by, [value], {"__upto": Prefix("sum", F.col(count))})
    totals = known.groupBy(*by).agg(F.sum(count).alias("__total"))
    at_least = lambda q: F.min(F.when(F.col("__upto") >= F.col("__total") * F.lit(q), F.col(value)))
    return ranked.join(totals, by).groupBy(*by).agg(*[at_least(q).alias(name) for name, q in wanted.items()])
