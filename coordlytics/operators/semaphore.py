"""Semaphores and their permits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from coordlytics.functions.columns import expiry, instant, permit_live, seconds_between
from coordlytics.operators.relations import KEY
from coordlytics.plans.ordered import HELD, Prefix, bucketed, busy_keys, composed_scan, ordered_scan, running_balance


def semaphore_status(semaphores: DataFrame, permits: DataFrame, as_of: str) -> DataFrame:
    """Permits in use and available; a negative number is reported as it is."""
    now = instant(as_of)
    live = permits.filter((F.col("acquired_at").isNull() | (F.col("acquired_at") <= now)) & permit_live(now))
    used = live.groupBy("ns", F.col("semaphore").alias("name")).agg(F.count(F.lit(1)).alias("used"))
    in_use = F.coalesce("used", F.lit(0))
    status = semaphores.join(used, KEY, "left").select(*KEY, "permits", in_use.alias("in_use"))
    return status.select(
        "*", (F.col("permits") - F.col("in_use")).alias("available"),
        F.when(F.col("permits") > F.col("in_use"), "Ready").otherwise("Full").alias("phase"))


def permit_status(permits: DataFrame, as_of: str) -> DataFrame:
    """Live permits are Granted, the others keep the phase they have and do not count."""
    live = permit_live(instant(as_of))
    return permits.withColumn("counts", live).withColumn(
        "phase", F.when(F.col("counts"), "Granted").otherwise(F.col("phase")))


def pair_in_order(log: DataFrame, keys: list[str], opens: str, closes: str) -> DataFrame:
    """Match the n-th effective close of a key with its n-th open.

    ``log`` has op, ts and, when two rows of a key can be equal in (ts, op), seq. A close that
    finds nothing open has no effect: the running balance clamped at zero tells which ones
    those are, so the match needs one pass, and the rows of (key, ordinal) together: one open and at most one close. The rows of a key
    are shuffled once, unless it is busy.
    """
    is_open = F.col("op") == opens
    steps = log.filter(F.col("op").isin(opens, closes)).withColumn("__side", F.when(is_open, 1).otherwise(0)).withColumn(
        "__d", F.when(is_open, 1).otherwise(-1))
    order = ["ts", "__side"] + (["seq"] if "seq" in log.columns else [])
    busy = busy_keys((steps, keys))(keys)
    in_order = Window.partitionBy(*keys).orderBy(*order)
    upto, earlier = in_order.rowsBetween(Window.unboundedPreceding, 0), in_order.rowsBetween(Window.unboundedPreceding, -1)
    few = (
        steps.filter(~busy).withColumns({"total": F.sum("__d").over(upto), "ups": F.sum("__side").over(upto)})
        .withColumns({"floor": F.min("total").over(upto), "floor_before": F.min("total").over(earlier)}))
    numbered = _numbered(few)
    # a key with a null is equal to none
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    end = F.max(F.when((F.col("__side") == 0) & known, F.col("ts"))).over(Window.partitionBy(*keys, "__n"))
    whole = numbered.filter("__side = 1 or effective").withColumn("closed_at", end).filter("__side = 1")
    many = _numbered(running_balance(steps.filter(busy), keys, order, F.col("__d")))
    starts = many.filter("__side = 1")
    ends = many.filter("__side = 0").filter("effective").select(*keys, "__n", F.col("ts").alias("closed_at"))
    apart = starts.join(ends, [*keys, "__n"], "left")
    return whole.select(*log.columns, "closed_at").unionByName(apart.select(*log.columns, "closed_at"))


def _numbered(level: DataFrame) -> DataFrame:
    """Steps with their running balance: __n, the ordinal of an open or close, and whether a close is effective."""
    low = F.least(F.lit(0), F.col("floor"))
    # effective closes so far = closes so far less those absorbed at zero
    ordinal = F.when(F.col("__side") == 1, F.col("ups")).otherwise(F.col("ups") - F.col("total") + low)
    return level.withColumns({"__n": ordinal, "effective": low == F.least(F.lit(0), F.col("floor_before"))})


def permit_intervals(events: DataFrame) -> DataFrame:
    """S3: how long each permit was held; a release ends the holder's oldest open permit."""
    paired = pair_in_order(events, [*KEY, "holder"], "acquire", "release")
    expires = expiry(F.col("ts"), F.col("ttl"))
    ended = F.least("closed_at", expires)
    reason = (
        F.when(F.col("closed_at").isNotNull() & (expires.isNull() | (F.col("closed_at") <= expires)), "release")
        .when(expires.isNotNull(), "expiry").otherwise("open"))
    return paired.select(
        *KEY, "holder", F.col("ts").alias("acquired_at"), F.col("closed_at").alias("released_at"),
        expires.alias("expires_at"), ended.alias("ended_at"), reason.alias("end_reason"))


def in_use_timeline(intervals: DataFrame, start: str = "acquired_at", end: str = "ended_at", spans: bool = False) -> DataFrame:
    """Permits in use after every change.

    Changes of one instant are summed first, so ends and starts at a tie cancel and a burst of
    simultaneous changes is a single row. With ``spans`` also until, the next change, and d, the change itself.
    """
    if not spans:
        busy = busy_keys((intervals, KEY))(KEY)
        net = bucketed(_steps(intervals.filter(busy), KEY, start, end), KEY, ["ts"]).groupBy(*HELD, *KEY, "ts").agg(F.sum("d").alias("d"))
        many = ordered_scan(net.filter("d <> 0"), KEY, ["ts"], {"in_use": Prefix("sum", F.col("d"))}).drop("d")
        # the key as one value, since a constant namespace would be left out of what the groups ask for, but not of the shuffle
        dealt = intervals.filter(~busy).select(F.struct(*KEY).alias("__key"), start, end).repartition("__key")
        whole = _steps(dealt, ["__key"], start, end).groupBy("__key", "ts").agg(F.sum("d").alias("d")).filter("d <> 0")
        upto = Window.partitionBy("__key").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        return whole.select("__key.*", "ts", F.sum("d").over(upto).alias("in_use")).unionByName(many)
    net = bucketed(_steps(intervals, KEY, start, end), KEY, ["ts"]).groupBy(*HELD, *KEY, "ts").agg(F.sum("d").alias("d")).filter("d <> 0")
    scanned = composed_scan(
        net, KEY, ["ts"],
        local=[{"__upto": lambda w: F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__next": lambda w: F.lead("ts").over(w)}],
        totals={"__sum": F.sum("d"), "__first": F.min("ts")},
        carries=[{"__start": lambda earlier, later: F.sum("__sum").over(earlier), "__later": lambda earlier, later: F.min("__first").over(later)}])
    return scanned.select(
        *HELD, *KEY, "ts", "d", (F.coalesce("__start", F.lit(0)) + F.col("__upto")).alias("in_use"),
        F.coalesce("__next", "__later").alias("until"))


def _steps(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    steps = intervals.select(*keys, F.explode(F.array(
        F.struct(F.col(start).alias("ts"), F.lit(1).alias("d")),
        F.struct(F.col(end).alias("ts"), F.lit(-1).alias("d")))).alias("s")).filter("s.ts is not null")
    return steps.select(*keys, "s.*")


def _with_spans(timeline: DataFrame) -> DataFrame:
    """``timeline`` with until and d, which it has if it was made with ``spans``."""
    if "until" in timeline.columns:
        return timeline
    scanned = composed_scan(
        timeline, KEY, ["ts"],
        local=[{"__next": lambda w: F.lead("ts").over(w), "__back": lambda w: F.lag("in_use").over(w)}],
        totals={"__first": F.min("ts"), "__last": F.max_by("in_use", "ts")},
        carries=[{"__later": lambda earlier, later: F.min("__first").over(later),
                  "__earlier": lambda earlier, later: F.last("__last").over(earlier)}])
    return scanned.select(
        *HELD, *KEY, "ts", "in_use", F.coalesce("__next", "__later").alias("until"),
        (F.col("in_use") - F.coalesce("__back", "__earlier", F.lit(0))).alias("d"))


def oversubscription(timeline: DataFrame, semaphores: DataFrame) -> DataFrame:
    """Maximal intervals in which more permits were in use than exist, with the peak excess."""
    steps = _with_spans(timeline).join(semaphores.select(*KEY, "permits"), KEY).filter(F.col("in_use") > F.col("permits"))
    excess = steps.select(*KEY, "ts", "until", (F.col("in_use") - F.col("permits")).alias("excess"),
                          F.when(F.col("in_use") - F.col("d") <= F.col("permits"), 1).otherwise(0).alias("__starts"))
    islands = ordered_scan(excess, KEY, ["ts"], {"episode": Prefix("sum", F.col("__starts"))})
    return (
        islands.groupBy(*KEY, "episode")
        .agg(F.min("ts").alias("started_at"), F.max("until").alias("ended_at"),
             F.max("excess").cast("long").alias("peak_excess"))
        .withColumn("episode", F.col("episode").cast("long")))


def peak_concurrency(timeline: DataFrame, semaphores: DataFrame, bucket: str = "month") -> DataFrame:
    """Per time bucket the peak, the time-weighted mean and the utilisation.

    A step that lasts over several buckets is split into one row per bucket it touches.
    """
    steps = _with_spans(timeline).filter("until is not null").select(*KEY, "ts", "in_use", "until")
    unit = F.expr(f"interval 1 {bucket}")
    last = F.date_trunc(bucket, F.col("until") - F.expr("interval 1 microsecond"))
    split = steps.withColumn("bucket", F.explode(F.sequence(F.date_trunc(bucket, "ts"), last, unit)))
    seconds = seconds_between(F.greatest("ts", "bucket"), F.least(F.col("until"), F.col("bucket") + unit))
    usage = split.groupBy(*KEY, "bucket").agg(
        F.max("in_use").cast("long").alias("peak"),
        F.sum(seconds).alias("covered_seconds"),
        F.sum(seconds * F.col("in_use")).cast("long").alias("permit_seconds"))
    capacity = F.col("permits") * F.col("covered_seconds")
    return usage.join(semaphores.select(*KEY, "permits"), KEY).select(
        *KEY, "bucket", "peak", "covered_seconds", "permit_seconds",
        F.round(F.col("permit_seconds") / F.col("covered_seconds"), 4).alias("mean_in_use"),
        F.round(F.col("permit_seconds") / capacity, 4).alias("utilisation"))


def permit_admission(semaphores: DataFrame, permits: DataFrame, as_of: str) -> DataFrame:
    """Live requests in order of arrival; those beyond the capacity would be denied."""
    now = instant(as_of)
    live = permits.filter((F.col("acquired_at") <= now) & permit_live(now)).withColumnRenamed("semaphore", "name")
    queued = ordered_scan(live, KEY, ["acquired_at", "seq"], {"position": Prefix("sum", F.lit(1))})
    return queued.join(semaphores.select(*KEY, "permits"), KEY).select(
        *KEY, "position", F.when(F.col("position") <= F.col("permits"), "Granted").otherwise("Denied").alias("phase"),
        "acquired_at")


def holder_usage(intervals: DataFrame, as_of: str) -> DataFrame:
    """Per holder its permits, those still open, hold times and those never released."""
    now = instant(as_of)
    known = intervals.filter(F.col("acquired_at") <= now)
    is_open = F.col("ended_at").isNull() | (F.col("ended_at") > now)
    stuck = (F.col("expires_at") <= now) & (F.col("released_at").isNull() | (F.col("released_at") > now))
    held = F.when(~is_open, seconds_between("acquired_at", "ended_at"))
    return known.groupBy(*KEY, "holder").agg(
        F.count(F.lit(1)).alias("permits"), F.count_if(is_open).alias("open_permits"),
        F.count_if(stuck).alias("stuck_permits"), F.max(held).alias("max_hold_seconds"),
        F.sum(held).alias("total_hold_seconds"))
