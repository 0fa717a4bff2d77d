"""Barriers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from coordlytics.functions.columns import instant, seconds_between
from coordlytics.functions.quantiles import discrete_quantiles
from coordlytics.operators.relations import KEY
from coordlytics.plans.durable import cut
from coordlytics.plans.ordered import HELD, Prefix, bucketed, busy_keys, composed_scan, inside_bucket, ordered_scan


def required():
    return F.coalesce("quorum", "expected").alias("required")


def deadline():
    return (F.col("created_at") + F.col("timeout")).alias("deadline")


def opening():
    """The required-th arrival ``nth``, if it came in time; not before the barrier existed."""
    in_time = F.col("deadline").isNull() | (F.col("nth") <= F.col("deadline"))
    return F.when(F.col("nth").isNotNull() & in_time, F.greatest("nth", "created_at"))


def first_arrivals(arrivals: DataFrame) -> DataFrame:
    """A holder arrives once, at its earliest record; its lowest seq breaks ties between holders.

    Two plain minima keep this a hash aggregation with partial sums before the shuffle.
    """
    return arrivals.groupBy("ns", F.col("barrier").alias("name"), "holder").agg(
        F.min("arrived_at").alias("arrived_at"), F.min("seq").alias("seq"))


def barrier_arrivals(arrivals: DataFrame) -> DataFrame:
    """Holders in order of arrival, one row per position.

    The list is kept as rows, because an array per barrier could not hold a very large fan-in.
    """
    ranked = ordered_scan(
        first_arrivals(arrivals), KEY, ["arrived_at", "seq", "holder"],
        {"position": Prefix("sum", F.lit(1))})
    return ranked.select(*KEY, F.col("position").cast("long").alias("position"), "holder", "arrived_at", "seq")


def barrier_opened_at(barriers: DataFrame, arrivals: DataFrame) -> DataFrame:
    """B2: when the required-th distinct arrival came, if not after the deadline.

    Arrivals older than the barrier count from its creation on. The rows of a barrier are shuffled once, by barrier. Of a busy one
    counts are partial sums and the required-th arrival is joined on (barrier, position), which is unique, so its rows never
    meet in one task.
    """
    spec = barriers.select(*KEY, "created_at", "expected", "quorum", required(), deadline())
    busy = busy_keys((arrivals, ["ns", "barrier"]))
    here, there = busy(KEY), busy(["ns", "barrier"])
    counted = _by_barrier(spec.filter(~here), arrivals.filter(~there)).unionByName(_by_position(spec.filter(here), arrivals.filter(there)))
    return counted.withColumn("opened_at", opening()).withColumn(
        "last_holder", F.when(F.col("opened_at").isNotNull(), F.col("last_holder"))).drop("nth")


def _by_position(spec: DataFrame, arrivals: DataFrame) -> DataFrame:
    """The spec with arrived, nth and last_holder, by joins on (barrier, position)."""
    ranked = barrier_arrivals(arrivals)
    arrived = ranked.groupBy(*KEY).agg(F.max("position").alias("arrived"))
    nth = ranked.select(
        *KEY, F.col("position").alias("required"), F.col("arrived_at").alias("nth"), F.col("holder").alias("last_holder"))
    return (
        spec.join(arrived, KEY, "left").withColumn("arrived", F.coalesce("arrived", F.lit(0)))
        .join(nth, [*KEY, "required"], "left"))


def _by_barrier(spec: DataFrame, arrivals: DataFrame) -> DataFrame:
    """The same with all rows of a barrier in one task.

    Holders are told apart, ranked and joined to the spec in the one shuffle by barrier. The join is on the barrier alone, to one row: the
    required-th arrival or, as it also has the number of arrivals, the last one.
    """
    # as one value, since a constant namespace would be left out of what the groups ask for, but not of the shuffle; nulls are equal to none
    key, own = F.struct(*KEY).alias("__key"), Window.partitionBy("__key")
    named = arrivals.withColumnRenamed("barrier", "name").filter(F.col("ns").isNotNull() & F.col("name").isNotNull())
    firsts = named.select(key, "holder", "arrived_at", "seq").repartition("__key").groupBy("__key", "holder").agg(
        F.min("arrived_at").alias("arrived_at"), F.min("seq").alias("seq"))
    ranked = firsts.select(
        "__key", F.col("holder").alias("__holder"), F.col("arrived_at").alias("__at"),
        F.row_number().over(own.orderBy("arrived_at", "seq", "holder")).cast("long").alias("__position"),
        F.count(F.lit(1)).over(own).alias("__arrived"))
    wanted = F.greatest(F.least("required", "__arrived"), F.lit(1))
    keyed = spec.withColumn("__spec", key)
    # a difference is no equality to deal rows by
    joined = keyed.join(ranked, (F.col("__spec") == F.col("__key")) & (F.col("__position") - wanted == 0), "left")
    nth = F.col("__position") == F.col("required")
    return joined.select(
        *KEY, "required", *[c for c in spec.columns if c not in (*KEY, "required")], F.coalesce("__arrived", F.lit(0)).alias("arrived"),
        F.when(nth, F.col("__at")).alias("nth"), F.when(nth, F.col("__holder")).alias("last_holder"))


def barrier_status(barriers: DataFrame, arrivals: DataFrame, as_of: str) -> DataFrame:
    """B1: phase, count and open time of every barrier that exists at ``as_of``."""
    now = instant(as_of)
    opened = barrier_opened_at(
        barriers.filter(F.col("created_at") <= now), arrivals.filter(F.col("arrived_at") <= now))
    phase = (
        F.when(F.col("opened_at").isNotNull(), "Open")
        .when(F.col("deadline") < now, "Failed").otherwise("Waiting"))
    return opened.select(
        *KEY, "arrived", F.col("required").cast("long").alias("required"), phase.alias("phase"), "opened_at")


def barrier_missing(roster: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Expected holders that have not arrived."""
    return roster.join(arrivals.select("ns", "barrier", "holder"), ["ns", "barrier", "holder"], "left_anti")


def barrier_phase_timeline(barriers: DataFrame, arrival_events: DataFrame) -> DataFrame:
    """Phase intervals, as arrivals come and are withdrawn and the deadline passes.

    ``arrival_events`` has ns, name, ts and delta (+1 or -1). Events of one instant are summed
    first, which is exact because a phase is only defined between instants. A count below the
    requirement is Waiting until the deadline and Failed after it; a count that reaches it
    before the deadline opens the barrier, one that reaches it later does not.
    """
    spec = barriers.select(*KEY, "created_at", required(), deadline())
    still = F.lit(0).cast("long").alias("delta")
    known = ["created_at", "required", "deadline"]
    steps = arrival_events.groupBy(*KEY, "ts").agg(F.sum("delta").alias("delta")).join(spec, KEY)
    # rank orders rows of one instant: the deadline is inclusive, so its own row comes after
    rows = (
        steps.select(*KEY, F.greatest("ts", "created_at").alias("ts"), F.lit(0).alias("rank"), "delta", *known)
        .unionByName(spec.select(*KEY, F.col("created_at").alias("ts"), F.lit(0).alias("rank"), still, *known))
        .unionByName(spec.filter("deadline is not null").select(
            *KEY, F.col("deadline").alias("ts"), F.lit(1).alias("rank"), still, *known)))
    order = ["ts", "rank"]
    rows = bucketed(rows, KEY, order).groupBy(*HELD, *KEY, *order, *known).agg(F.sum("delta").alias("delta"))
    in_time = F.col("deadline").isNull() | (F.struct("ts", "rank") < F.struct("deadline", F.lit(1)))
    # a bucket misses its requirement if its lowest count after the deadline does, given what came before it
    scanned = composed_scan(
        rows, KEY, order,
        local=[{"__upto": lambda w: F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0))}],
        totals={"__sum": F.sum("delta"), "__low": F.min(F.when(~in_time, F.col("__upto"))), "__needed": F.first("required")},
        carries=[{"__start": lambda earlier, later: F.coalesce(F.sum("__sum").over(earlier), F.lit(0))},
                 {"__missed": lambda earlier, later: F.max(F.col("__start") + F.col("__low") < F.col("__needed")).over(earlier)}])
    arrived = F.col("__start") + F.col("__upto")
    reached, reached_before = arrived >= F.col("required"), arrived - F.col("delta") >= F.col("required")
    rows_so_far = inside_bucket(order).rowsBetween(Window.unboundedPreceding, 0)
    rows_before = inside_bucket(order).rowsBetween(Window.unboundedPreceding, -1)
    missed = lambda rows: F.coalesce(F.col("__missed"), F.lit(False)) | F.coalesce(F.max(~in_time & ~reached).over(rows), F.lit(False))
    waiting = lambda enough: F.when(enough, "Open").otherwise("Waiting")
    after = lambda failed: F.when(failed, "Failed").otherwise("Open")
    # the phase just before a row: nothing before the creation, still in time before the row of the deadline
    before = F.when((F.col("ts") == F.col("created_at")) & (F.col("rank") == 0), F.lit(None)).when(
        in_time | (F.col("rank") == 1), waiting(reached_before)).otherwise(after(missed(rows_before)))
    phased = scanned.select(
        *HELD, *KEY, *order, F.when(in_time, waiting(reached)).otherwise(after(missed(rows_so_far))).alias("phase"),
        before.alias("__before"), arrived.cast("long").alias("arrived"))
    changes = phased.filter(F.col("__before").isNull() | (F.col("__before") != F.col("phase"))).drop("__before")
    ended = ordered_scan(changes, KEY, order, {
        "ended_at": Prefix("prev", F.col("ts"), reverse=True),
        "opened_at": Prefix("min", F.when(F.col("phase") == "Open", F.col("ts")))})
    return ended.select(*KEY, "phase", F.col("ts").alias("started_at"), "ended_at", "arrived", "opened_at")


def barrier_waits(barriers: DataFrame, arrivals: DataFrame) -> DataFrame:
    """How long each holder waited for the opening, and who the stragglers were."""
    opened = barrier_opened_at(barriers, arrivals).filter("opened_at is not null").select(*KEY, "required", "opened_at")
    timed = barrier_arrivals(arrivals).join(opened, KEY)
    wait = F.greatest(F.lit(0), seconds_between("arrived_at", "opened_at"))
    return timed.select(
        *KEY, "holder", "position", wait.alias("wait_seconds"),
        (F.col("position") == F.col("required")).alias("is_last_needed"),
        (F.col("position") > F.col("required")).alias("late"))


def barrier_wait_summary(waits: DataFrame) -> DataFrame:
    """Per barrier the waits of those who came in time, and the holder all others waited for."""
    on_time = waits.filter("not late")
    histogram = cut(on_time.groupBy(*KEY, "wait_seconds").agg(
        F.count(F.lit(1)).alias("n"), F.max("position").alias("last"), F.max_by("holder", "position").alias("holder")))
    totals = histogram.groupBy(*KEY).agg(
        F.sum("n").alias("waiters"), F.max("wait_seconds").alias("max_wait_seconds"),
        F.max_by("holder", "last").alias("last_holder"))
    median = discrete_quantiles(histogram, KEY, "wait_seconds", "n", {"p50_wait_seconds": 0.5})
    return totals.join(median, KEY, "left")


def stage_chain(stages: DataFrame, opened: DataFrame) -> DataFrame:
    """Stage k of a pipeline starts when the barrier of stage k-1 opens.

    ``stages`` has ns, pipeline, stage and name (its barrier); ``opened`` the open time and the
    last needed holder per barrier.
    """
    staged = stages.join(opened, KEY, "left")
    scanned = ordered_scan(staged, ["ns", "pipeline"], ["stage", "name"], {
        "started_at": Prefix("prev", F.col("opened_at")),
        "unopened_before": Prefix("sum", F.when(F.col("opened_at").isNull(), 1).otherwise(0), inclusive=False),
    })
    blocked = F.coalesce("unopened_before", F.lit(0)) > 0
    return scanned.select(
        "ns", "pipeline", "stage", "name", "started_at", F.col("opened_at").alias("ended_at"),
        blocked.alias("blocked"),
        F.when(~blocked, seconds_between("started_at", "opened_at")).alias("stage_seconds"),
        F.col("last_holder").alias("critical_holder"))


def quorum_slack(barriers: DataFrame, arrivals: DataFrame, as_of: str) -> DataFrame:
    """Arrivals still outstanding, and whether the quorum opened the barrier early."""
    status = barrier_status(barriers, arrivals, as_of)
    spec = barriers.select(*KEY, "expected", "quorum")
    missing = F.greatest(F.lit(0), F.col("expected") - F.col("arrived"))
    early = F.col("quorum").isNotNull() & (F.col("phase") == "Open") & (F.col("arrived") < F.col("expected"))
    return status.join(spec, KEY).select(
        *KEY, "arrived", missing.cast("long").alias("outstanding"),
        (F.col("expected") - F.coalesce("quorum", "expected")).cast("long").alias("tolerated"),
        early.alias("opened_early"))
