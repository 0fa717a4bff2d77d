"""Waiters and optimistic updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from coordlytics.functions.columns import DEFAULT_WAIT, micros
from coordlytics.functions.quantiles import discrete_quantiles
from coordlytics.operators.relations import KEY
from coordlytics.plans.durable import cut
from coordlytics.plans.ordered import Prefix, busy_keys, split_scan


def wait_outcomes(
    waiters: DataFrame, transitions: DataFrame, default_timeout: str = DEFAULT_WAIT
) -> DataFrame:
    """How each wait ended: opened, failed or timed out, and after how long.

    The phase at the start is the last transition before it, the next one the first after it:
    two running values over the union of both logs, no interval join. Waiters have ns, name,
    ts, seq and timeout; transitions ns, name, ts, phase and, if any share an instant, seq. All
    transitions of an instant count for the waits that begin at it. Only Open and Failed end a wait.
    """
    seq = F.col("seq") if "seq" in transitions.columns else F.lit(0).cast("long")
    rows = (
        transitions.select(*KEY, "ts", F.lit(0).alias("side"), seq.alias("seq"), F.struct("ts", "phase").alias("t"), F.lit(None).cast("interval day to second").alias("timeout"))
        .unionByName(waiters.select(*KEY, "ts", F.lit(1).alias("side"), "seq", F.lit(None).alias("t"), "timeout")))
    ended = F.when(F.col("t.phase").isin("Open", "Failed"), F.col("t"))
    busy = busy_keys((waiters, KEY), (transitions, KEY))(KEY)
    seen = split_scan(rows, KEY, ["ts", "side", "seq"], {
        "current": Prefix("last", F.col("t")),
        "coming": Prefix("last", ended, inclusive=False, reverse=True)}, busy)
    limit = F.coalesce("timeout", F.expr(default_timeout))
    already = F.when(F.col("current.phase").isin("Open", "Failed"), F.col("current.phase"))
    later = F.when(F.col("coming.ts") <= F.col("ts") + limit, F.col("coming.phase"))
    outcome = (
        F.when(F.coalesce(already, later) == "Open", "opened")
        .when(F.coalesce(already, later) == "Failed", "failed").otherwise("timeout"))
    until = F.when(already.isNotNull(), F.col("ts")).when(later.isNotNull(), F.col("coming.ts")).otherwise(F.col("ts") + limit)
    return seen.filter("side = 1").select(
        *KEY, "ts", "seq", outcome.alias("outcome"), F.floor((micros(until) - micros("ts")) / 1_000_000).cast("long").alias("wait_seconds"))


def update_conflicts(updates: DataFrame) -> DataFrame:
    """Per attempt, whether it was the first to write its base version.

    The winner is a minimum per (key, version), reduced before the shuffle.
    """
    version = [*KEY, "base_version"]
    first = updates.groupBy(*version).agg(F.min(F.struct("ts", "seq")).alias("first"))
    return updates.join(first, version).select(
        *version, "update_id", "ts", "seq", F.when(F.col("first") == F.struct("ts", "seq"), "applied").otherwise("conflict").alias("outcome"))


def update_retries(conflicts: DataFrame, max_tries: int = 10) -> DataFrame:
    """Tries, conflicts and result of every logical update."""
    return conflicts.groupBy(*KEY, "update_id").agg(
        F.count(F.lit(1)).alias("tries"), F.count_if(F.col("outcome") == "conflict").alias("conflicts"),
        F.bool_or(F.col("outcome") == "applied").alias("applied")
    ).withColumn("exhausted", ~F.col("applied") & (F.col("tries") >= max_tries))


def wait_percentiles(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Outcomes counted and exact wait percentiles per group, all from one stored histogram."""
    histogram = cut(outcomes.groupBy(*by, "wait_seconds").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("opened", "failed", "timeout")]))
    counts = histogram.groupBy(*by).agg(*[F.sum(o).alias(o) for o in ("opened", "failed", "timeout")])
    waits = discrete_quantiles(histogram, by, "wait_seconds", "n", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return counts.join(waits, by, "left")
