"""Wait groups, a counter that never drops below zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from coordlytics.functions.columns import instant, seconds_between
from coordlytics.operators.relations import KEY
from coordlytics.plans.ordered import HELD, Prefix, ordered_scan, running_balance

ORDER = ["ts", "seq"]


def waitgroup_counter(deltas: DataFrame, more: bool = False) -> DataFrame:
    """The counter after every change, and the part of the change lost at zero.

    The clamped counter is the prefix sum minus its lowest value so far when that is negative.
    """
    level = running_balance(deltas, KEY, ORDER, F.col("delta"), more)
    clamped = lambda floor: -F.least(F.lit(0), floor)
    lost = clamped(F.col("floor")) - clamped(F.col("floor_before"))
    return level.select(
        *(HELD if more else []), *KEY, *ORDER, F.col("delta").cast("long").alias("delta"),
        (F.col("total") + clamped(F.col("floor"))).alias("counter"), lost.alias("lost"))


def waitgroup_status(waitgroups: DataFrame, deltas: DataFrame, as_of: str) -> DataFrame:
    """Last counter; a group at zero, also a new one, is Done.

    The last counter is the whole sum less its lowest prefix, so a hash aggregation finds it.
    """
    past = deltas.filter(F.col("ts") <= instant(as_of))
    ends = running_balance(past, KEY, ORDER, F.col("delta")).groupBy(*KEY).agg(
        F.sum("delta").alias("sum"), F.min("total").alias("low"))
    counter = F.coalesce(F.col("sum") - F.least(F.lit(0), F.col("low")), F.lit(0))
    return waitgroups.join(ends, KEY, "left").select(
        *KEY, counter.alias("counter"), F.when(counter <= 0, "Done").otherwise("Waiting").alias("phase"))


def waitgroup_episodes(deltas: DataFrame) -> DataFrame:
    """Each stretch from the first add to the return to zero, with its peak."""
    counted = waitgroup_counter(deltas, more=True)
    is_zero = F.when(F.col("counter") == 0, 1).otherwise(0)
    numbered = ordered_scan(counted, KEY, ORDER, {
        "episode": Prefix("sum", is_zero, inclusive=False),
        "__before": Prefix("prev", F.col("counter")),
    })
    # a zero row that follows a zero row belongs to no episode
    busy = numbered.filter((F.col("counter") > 0) | (F.coalesce("__before", F.lit(0)) > 0))
    grouped = busy.groupBy(*KEY, F.coalesce("episode", F.lit(0)).alias("__e")).agg(
        F.min("ts").alias("started_at"),
        F.max(F.when(F.col("counter") == 0, F.col("ts"))).alias("done_at"),
        F.max("counter").alias("peak"))
    return grouped.drop("__e").withColumn("duration_seconds", seconds_between("started_at", "done_at"))


def lost_dones(deltas: DataFrame) -> DataFrame:
    """Changes absorbed because the counter was at zero already."""
    return waitgroup_counter(deltas).filter("lost > 0")
