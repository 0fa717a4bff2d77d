"""M1-M7: mutual exclusion locks."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, functions as F, types as T

from coordlytics.functions.columns import DEFAULT_WAIT, instant, seconds_between
from coordlytics.functions.quantiles import discrete_quantiles
from coordlytics.functions.sketches import distinct_estimate, distinct_sketch, merged, quantile_estimate, quantile_sketch
from coordlytics.operators.relations import KEY
from coordlytics.operators.semaphore import pair_in_order
from coordlytics.plans.durable import cut
from coordlytics.plans.ordered import ComposedFold, Fold, Prefix, composed_fold, ordered_fold, ordered_scan

ORDER = ["ts", "seq"]
#: The end of what has not ended.
FAR = "timestamp '9999-01-01 00:00:00'"
STRETCH = "__stretch"


def with_micros(ops: DataFrame) -> DataFrame:
    """Times and ttl as microseconds, the form the folds compute with."""
    epoch = F.timestamp_micros(F.lit(0))
    return ops.withColumns({
        "ts_us": F.unix_micros("ts"), "ttl_us": F.unix_micros(epoch + F.col("ttl"))})


def as_timestamps(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.timestamp_micros(c) for c in columns})


def fields(text: str) -> T.StructType:
    return T.StructType([
        T.StructField(name, {"long": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType()}[kind])
        for name, kind in (part.split() for part in text.split(","))])


class MutexFold(ComposedFold):
    """State: (holder, locked_at, expires_at) or None. Emits outcomes, tenures or the last state.

    What a stretch of operations does to an entering hold depends on when the hold ends: with its holder's first unlock or
    with the first operation after its expiry, whichever comes first. From there on the mutex is free, and where a
    free mutex ends up is known for every operation from the end of the stretch backwards.
    """

    inputs = ["op", "holder", "ts_us", "ttl_us", "seq"]
    ends = "end_us"
    schemas = {
        "outcomes": fields("seq long,ts long,op string,holder string,ok boolean,outcome string,blocked_by string,locked_at long,expires_at long"),
        "tenures": fields("holder string,locked_at long,ended_at long,expires_at long,end_reason string"),
        "status": fields("holder string,locked_at long,expires_at long"),
    }

    def __init__(self, emits: str, as_of_us: int | None = None, announce: bool = False):
        self.emits, self.as_of_us, self.announce = emits, as_of_us, announce
        self.output = self.schemas[emits]

    def start(self):
        return None

    def due(self, state):
        return None if state is None else state[2]

    def _ended(self, state, at, reason, emit):
        if self.emits == "tenures":
            emit((state[0], state[1], at, state[2], reason))
        elif self.announce and reason == "ttl":
            emit((None, at, "expire", state[0], True, "expired", None, state[1], state[2]))

    def expire(self, state, now, emit):
        """A lock is alive at the instant it expires and gone right after it."""
        if state is not None and state[2] is not None and state[2] < now:
            self._ended(state, state[2], "ttl", emit)
            return None
        return state

    def step(self, state, row, emit):
        op, holder, ts, ttl, seq = row
        if state is not None and state[2] is not None and state[2] < ts:
            state = self.expire(state, ts, emit)
        blocked_by, before = None, state
        if op == "lock":
            if state is None:
                state = (holder, ts, None if ttl is None else ts + ttl)
                before, ok, outcome = state, True, "acquired"
            else:
                ok, outcome, blocked_by = False, "locked", state[0]
        elif not holder:
            ok, outcome = False, "holder_required"
        elif state is not None and state[0] == holder:
            self._ended(state, ts, "unlock", emit)
            state, ok, outcome = None, True, "released"
        else:
            ok, outcome = False, "not_holder"
        if self.emits == "outcomes":
            mine = before if ok else (None, None, None)
            emit((seq, ts, op, holder, ok, outcome, blocked_by, mine[1], mine[2]))
        return state

    def summary(self, rows):
        """(end if free, unlocks, ends): per holder the instant of the first unlock and the state at the end if free after it;
        and that state if free from the first operation later than an instant on, as (instant before which it holds, state)."""
        times = [ts for _, _, ts, _, _ in rows]
        free = [None] * (len(rows) + 1)  # the state at the end, if the mutex is free before row i
        unlocks: dict = {}  # holder -> the next row that unlocks for it
        for i in range(len(rows) - 1, -1, -1):
            op, holder, ts, ttl, _ = rows[i]
            free[i] = free[i + 1]
            if op == "lock":
                expires = None if ttl is None else ts + ttl
                late = len(rows) if expires is None else bisect_right(times, expires, i + 1)
                unlock = unlocks.get(holder, len(rows))
                if unlock < late:
                    free[i] = free[unlock + 1]
                elif late < len(rows):
                    free[i] = free[late]
                else:
                    free[i] = (holder, ts, expires)
            elif holder:
                unlocks[holder] = i
        ends = []
        for i, ts in enumerate(times):
            if ends and ends[-1][1] == free[i]:
                ends[-1] = (ts, free[i])
            else:
                ends.append((ts, free[i]))
        return free[0], {h: (times[i], free[i + 1]) for h, i in unlocks.items()}, ends

    def through(self, summary, state):
        free, unlocks, ends = summary
        if state is None:
            return free
        holder, _, expires = state
        unlocked = unlocks.get(holder)
        if unlocked is not None and (expires is None or unlocked[0] <= expires):
            return unlocked[1]
        if expires is not None and expires < ends[-1][0]:
            return ends[bisect_right(ends, expires, key=lambda e: e[0])][1]
        return state

    def finish(self, state, emit, end):
        now = self.as_of_us if end is None else end
        if now is not None:
            state = self.expire(state, now, emit)
        if self.emits == "tenures" and state is not None:
            self._ended(state, None, "open", emit)
        if self.emits == "status":
            emit(state or (None, None, None))


def _as_of_us(as_of: str | None) -> int | None:
    if as_of is None:
        return None
    from datetime import datetime, timezone

    parsed = datetime.fromisoformat(as_of).replace(tzinfo=timezone.utc)
    return int(parsed.timestamp()) * 1_000_000 + parsed.microsecond


def _until(ops: DataFrame, as_of: str | None) -> DataFrame:
    return ops if as_of is None else ops.filter(F.col("ts") <= instant(as_of))


def stretched(ops: DataFrame, locks: list[str]) -> DataFrame:
    """Operations in the form the folds take, cut into stretches at silences longer than any ttl in force.

    Once every lock that was ever asked for would have expired, the lock is free whatever happened before,
    so stretches are folded independently. A lock without a ttl never expires, so a log in which those
    occur is cut up to the first one and is one stream from there on. ``end_us`` is where the next
    stretch begins, null for the last one.
    """
    until = F.when(F.col("op").isin(*locks), F.coalesce(F.col("ts") + F.col("ttl"), F.expr(FAR)))
    reach = ordered_scan(ops, KEY, ORDER, {"__reach": Prefix("max", until, inclusive=False)}, more=True)
    fresh = F.col("__reach").isNull() | (F.col("__reach") < F.col("ts"))
    cuts = ordered_scan(reach, KEY, ORDER, {
        STRETCH: Prefix("sum", F.when(fresh, 1).otherwise(0)),
        "__next": Prefix("last", F.when(fresh, F.col("ts")), inclusive=False, reverse=True)})
    return with_micros(cuts).withColumn("end_us", F.unix_micros("__next")).drop("__reach", "__next")


def replayed(stretches: DataFrame, fold: Fold, times: list[str]) -> DataFrame:
    return as_timestamps(ordered_fold(stretches, [*KEY, STRETCH], ORDER, fold).drop(STRETCH), times)


def last_stretches(stretches: DataFrame) -> DataFrame:
    """Only these decide the state at the end of the log."""
    return stretches.filter("end_us is null")


def _composed(ops: DataFrame, fold: MutexFold, times: list[str], only_last: bool = False) -> DataFrame:
    return as_timestamps(composed_fold(with_micros(ops), KEY, ORDER, fold, only_last), times)


def mutex_replay(ops: DataFrame) -> DataFrame:
    """M2: the outcome of every operation, given all those before it on the same mutex."""
    return _composed(ops, MutexFold("outcomes"), ["ts", "locked_at", "expires_at"])


def mutex_tenures(ops: DataFrame, as_of: str | None = None) -> DataFrame:
    """M3: who held the mutex from when to when, and why the tenure ended.

    Emitted by the same pass as the outcomes, so no second shuffle pairs locks with unlocks.
    """
    return _composed(_until(ops, as_of), MutexFold("tenures", _as_of_us(as_of)), ["locked_at", "ended_at", "expires_at"])


def mutex_status(ops: DataFrame, as_of: str) -> DataFrame:
    """M1: current holder; an expired lock is Unlocked. Only the last operations of a mutex are replayed."""
    out = _composed(_until(ops, as_of), MutexFold("status", _as_of_us(as_of)), ["locked_at", "expires_at"], only_last=True)
    return out.withColumn("phase", F.when(F.col("holder").isNull(), "Unlocked").otherwise("Locked"))


def mutex_rejections(replay: DataFrame) -> DataFrame:
    """M4: refused operations, with the holder in the way."""
    return replay.filter(~F.col("ok")).select(*KEY, *ORDER, "op", "holder", "outcome", "blocked_by")


def mutex_contention(replay: DataFrame, tenures: DataFrame, bucket: str = "day") -> DataFrame:
    """M5: attempts, success, contenders, hold times and time held, per mutex and time bucket.

    A tenure that lasts over several buckets counts in each for the time it spends there.
    """
    per_holder = replay.filter("op = 'lock'").groupBy(*KEY, F.date_trunc(bucket, "ts").alias("bucket"), "holder").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("ok"))
    attempts = per_holder.groupBy(*KEY, "bucket").agg(
        F.sum("n").alias("attempts"), F.sum("ok").alias("acquired"), F.count("holder").alias("contenders"))
    closed = tenures.filter("ended_at is not null")
    holds = cut(closed.groupBy(
        *KEY, F.date_trunc(bucket, "locked_at").alias("bucket"), seconds_between("locked_at", "ended_at").alias("hold")
    ).agg(F.count(F.lit(1)).alias("n")))
    started = discrete_quantiles(
        holds, [*KEY, "bucket"], "hold", "n", {"p50_hold_seconds": 0.5, "p95_hold_seconds": 0.95})
    unit = F.expr(f"interval 1 {bucket}")
    touched = closed.withColumn("bucket", F.explode(F.sequence(
        F.date_trunc(bucket, "locked_at"), F.date_trunc(bucket, "ended_at"), unit)))
    inside = seconds_between(F.greatest("locked_at", "bucket"), F.least(F.col("ended_at"), F.col("bucket") + unit))
    busy = touched.groupBy(*KEY, "bucket").agg(F.sum(inside).alias("held_seconds"))
    by = [*KEY, "bucket"]
    joined = attempts.join(started, by, "full").join(busy, by, "full")
    return joined.select(
        *by, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("attempts", "acquired", "contenders", "held_seconds")],
        "p50_hold_seconds", "p95_hold_seconds",
        F.round(F.col("acquired") / F.col("attempts"), 4).alias("success_rate"))


def contention_sketches(replay: DataFrame, tenures: DataFrame, bucket: str = "day") -> DataFrame:
    """M5 to be kept: per mutex and time bucket the attempts, and sketches of the contenders and of the hold times.

    Merged over wider buckets (`wider_contention`) they answer for months what no one wants to read days for again.
    """
    asked = replay.filter("op = 'lock'").groupBy(*KEY, F.date_trunc(bucket, "ts").alias("bucket")).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("ok").alias("acquired"), distinct_sketch("holder", "contenders"))
    held = tenures.filter("ended_at is not null").groupBy(*KEY, F.date_trunc(bucket, "locked_at").alias("bucket")).agg(
        quantile_sketch(seconds_between("locked_at", "ended_at").cast("long"), "holds"))
    return asked.join(held, [*KEY, "bucket"], "full")


def wider_contention(sketches: DataFrame, bucket: str) -> DataFrame:
    """Contention per ``bucket``, from sketches of narrower ones; contenders and quantiles are estimates (`functions.sketches`)."""
    wide = merged(sketches.withColumn("bucket", F.date_trunc(bucket, "bucket")), [*KEY, "bucket"])
    return wide.select(
        *KEY, "bucket", F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("acquired", F.lit(0)).alias("acquired"),
        F.coalesce(distinct_estimate("contenders"), F.lit(0)).alias("contenders"),
        quantile_estimate("holds", 0.5).alias("p50_hold_seconds"), quantile_estimate("holds", 0.95).alias("p95_hold_seconds"))


def with_open_ends(intervals: DataFrame) -> DataFrame:
    """Intervals that have not ended reach beyond all others."""
    return intervals.withColumn("end_at", F.coalesce("end_at", F.expr(FAR)))


def _ended(end: Column) -> Column:
    return F.when(end < F.expr(FAR), end)


def merged_holds(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or touching intervals of one holder joined into one."""
    by = [*keys, "holder"]
    order = ["start_at", "seq"]
    reach = ordered_scan(intervals, by, order, {"__reach": Prefix("max", F.col("end_at"), inclusive=False)}, more=True)
    new = F.when(F.col("__reach").isNull() | (F.col("__reach") < F.col("start_at")), 1).otherwise(0)
    islands = ordered_scan(reach, by, order, {"__island": Prefix("sum", new)})
    return islands.groupBy(*by, "__island").agg(
        F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"), F.min("seq").alias("seq")).drop("__island")


def exclusion_violations(intervals: DataFrame) -> DataFrame:
    """M6: holds that began while another holder still held the same mutex.

    Each holder's own intervals are merged first; after that any overlap is between two
    holders, and the furthest end among the earlier ones decides. A hold without an end goes on. One
    row per offending hold, never one per pair.
    """
    merged = merged_holds(with_open_ends(intervals), KEY)
    furthest = ordered_scan(merged, KEY, ["start_at", "seq"], {
        "__far": Prefix("max", F.struct("end_at", "holder"), inclusive=False)})
    both = F.least("end_at", "__far.end_at")
    return furthest.filter(F.col("__far.end_at") > F.col("start_at")).select(
        *KEY, "holder", "start_at", _ended(F.col("end_at")).alias("end_at"), F.col("__far.holder").alias("held_by"),
        F.when(both < F.expr(FAR), seconds_between("start_at", both)).alias("overlap_seconds"))


def lock_wait_times(ops: DataFrame, timeout: str = DEFAULT_WAIT) -> DataFrame:
    """M7: time from a holder's request to its lock; too long or never is a timeout."""
    paired = pair_in_order(ops, [*KEY, "holder"], "request", "acquire")
    limit = F.expr(timeout)
    in_time = F.col("closed_at").isNotNull() & (F.col("closed_at") <= F.col("ts") + limit)
    return paired.select(
        *KEY, "holder", "seq", F.col("ts").alias("requested_at"), F.col("closed_at").alias("acquired_at"),
        F.when(in_time, "acquired").otherwise("timeout").alias("outcome"),
        F.when(in_time, seconds_between("ts", "closed_at")).alias("wait_seconds"))
