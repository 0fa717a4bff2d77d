"""Status reports over all kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from coordlytics.functions.columns import instant, micros, seconds_between
from coordlytics.operators.relations import KEY
from coordlytics.plans.ordered import Prefix, ordered_scan

CLOCK = "HH:mm:ss"
FULL_TIME = "yyyy-MM-dd HH:mm:ss"


def status_all(**status: DataFrame) -> DataFrame:
    """One table over kinds. Each frame brings ns, name, phase and any of used, total, holder."""
    parts = [df.withColumn("kind", F.lit(kind)) for kind, df in status.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    for column, kind_of in (("used", "long"), ("total", "long"), ("holder", "string")):
        out = out.withColumn(column, F.col(column).cast(kind_of) if column in out.columns else F.lit(None).cast(kind_of))
    holder = F.when(F.col("kind") == "Lease", F.coalesce("holder", F.lit("Available"))).otherwise(F.col("holder"))
    return out.select("kind", *KEY, "phase", "used", "total", holder.alias("holder"))


def phase_summary(status: DataFrame) -> DataFrame:
    """Counts by namespace, kind and phase, with subtotals."""
    return status.rollup("ns", "kind", "phase").agg(F.count(F.lit(1)).alias("resources"))


def kind_counts(status: DataFrame) -> DataFrame:
    """Number of resources per kind."""
    return status.groupBy("kind").agg(F.count(F.lit(1)).alias("resources"))


def status_detail(kind: str, status: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """The rows a detail view of one kind prints, resource first, then its children.

    Children are rows of their own, as a resource may have any number of them.
    """
    clock = lambda c: F.date_format(c, CLOCK)
    when_or = lambda c, other: F.coalesce(clock(c), F.lit(other))
    ratio = lambda a, b: F.concat_ws("/", F.col(a).cast("string"), F.col(b).cast("string"))
    text = {
        "semaphore": lambda: [ratio("in_use", "permits")],
        "barrier": lambda: [ratio("arrived", "required"), F.date_format("opened_at", FULL_TIME)],
        "lease": lambda: [F.coalesce("holder", F.lit("Available")), when_or("expires_at", "N/A")],
        "mutex": lambda: [F.coalesce("holder", F.lit("N/A")), when_or("expires_at", "N/A")],
        "rwmutex": lambda: [F.coalesce("writer", "readers", F.lit("N/A"))],
        "once": lambda: [F.coalesce("executor", F.lit("N/A")), when_or("executed_at", "N/A")],
        "waitgroup": lambda: [F.col("counter").cast("string")],
        "gate": lambda: [ratio("conditions_met", "conditions_total")],
    }[kind]
    text = F.concat_ws(" ", "phase", *text())
    own = status.select(*KEY, F.lit("resource").alias("part"), text.alias("detail"))
    if children is None:
        return own
    child = {
        "semaphore": ("permit", lambda: F.concat_ws(" ", "holder", when_or("expires_at", "Active"))),
        "barrier": ("arrival", lambda: F.col("holder")),
        "lease": ("pending request", lambda: F.concat_ws(" ", "holder", F.col("priority").cast("string"))),
        "gate": ("condition", lambda: F.concat_ws(" ", F.concat_ws("/", "type", "condition"), F.when(F.col("met"), "met").otherwise("not met"), "message")),
    }[kind]
    listed = children.select(*KEY, F.lit(child[0]).alias("part"), child[1]().alias("detail"))
    return own.unionByName(listed.join(status.select(*KEY), KEY, "left_semi"))


def as_json(df: DataFrame) -> DataFrame:
    """Every row as one JSON text, the other output form of a report."""
    return df.select(*KEY, F.to_json(F.struct(*df.columns)).alias("json"))


def expiring_soon(deadlines: DataFrame, as_of: str, k: int) -> DataFrame:
    """T4: the next k deadlines of all kinds. Each task keeps k rows, nothing else is sorted."""
    now = instant(as_of)
    ahead = deadlines.filter(F.col("deadline") > now)
    return ahead.select(
        "kind", *KEY, "deadline", seconds_between(now, "deadline").alias("remaining_seconds")
    ).orderBy("deadline", "kind", "ns", "name").limit(k)


def transition_log(status_log: DataFrame) -> DataFrame:
    """T5: how often each phase follows another, and how long the first lasted.

    ``status_log`` has kind, ns, name, ts, seq and phase; rows that repeat a phase are no
    transition and are dropped first.
    """
    keys, order = ["kind", *KEY], ["ts", "seq"]
    before = ordered_scan(status_log, keys, order, {"__b": Prefix("prev", F.col("phase"))}, more=True)
    changes = before.filter(F.col("__b").isNull() | (F.col("__b") != F.col("phase")))
    after = ordered_scan(changes, keys, order, {"__n": Prefix("prev", F.struct("phase", "ts"), reverse=True)})
    dwell = micros("__n.ts") - micros("ts")
    return after.filter("__n is not null").groupBy(
        "kind", F.col("phase").alias("from_phase"), F.col("__n.phase").alias("to_phase")).agg(
        F.count(F.lit(1)).alias("transitions"), F.floor(F.sum(dwell) / 1_000_000).cast("long").alias("dwell_seconds"))
