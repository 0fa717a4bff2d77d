"""Read-write locks."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, functions as F

from coordlytics.functions.columns import seconds_between
from coordlytics.operators.mutex import (
    ORDER, _as_of_us, _until, as_timestamps, fields, with_micros, with_open_ends)
from coordlytics.operators.relations import KEY
from coordlytics.plans.ordered import ComposedFold, Prefix, composed_fold, ordered_scan

FREE = (None, None, None, None)


class RWMutexFold(ComposedFold):
    """State: (writer, readers, locked_at, expires_at); a session is a maximal locked stretch.

    ``readers`` is None or (number of read locks, holder -> places in the order of read locks); it is
    changed in place, so an operation costs the same however many readers there are. Readers share one expiry which every new reader resets. State also carries, for the open
    read session, the first reader's expiry and the number of read locks.

    What a stretch of operations does to an entering session follows from few things: when each of its readers
    leaves first, when the readers that join meanwhile are all gone again, and when the expiry that they
    push passes. Where a session ends the lock is free, and where a free lock ends up is known for every
    operation from the end of the stretch backwards.
    """

    inputs = ["op", "holder", "ts_us", "ttl_us", "seq"]
    ends = "end_us"
    schemas = {
        "outcomes": fields("seq long,ts long,op string,holder string,ok boolean,outcome string,readers long,writer string,expires_at long"),
        "levels": fields("ts long,readers long,writer string"),
        "sessions": fields("started_at long,first_expiry long,ended_at long,end_reason string,read_locks long"),
        "status": fields("writer string,readers string,locked_at long,expires_at long"),
    }

    def __init__(self, emits: str, as_of_us: int | None = None, announce: bool = False):
        self.emits, self.as_of_us, self.announce = emits, as_of_us, announce
        self.output = self.schemas[emits]

    def start(self):
        return (FREE, None)

    def _close(self, session, at, reason, emit):
        if self.emits == "sessions" and session is not None:
            emit((session[0], session[1], at, reason, session[2]))

    def _level(self, ts, lock, emit):
        if self.emits == "levels":
            emit((ts, self._count(lock), lock[0]))

    @staticmethod
    def _count(lock):
        return lock[1][0] if lock[1] else 0

    def due(self, state):
        return state[0][3]

    def expire(self, state, now, emit):
        lock, session = state
        if lock[3] is not None and lock[3] < now:
            self._close(session, lock[3], "ttl", emit)
            self._level(lock[3], FREE, emit)
            if self.announce:
                emit((None, lock[3], "expire", lock[0], True, "expired", 0, None, None))
            return (FREE, None)
        return state

    def step(self, state, row, emit):
        op, holder, ts, ttl, seq = row
        lock, session = self.expire(state, ts, emit)
        writer, readers, locked_at, expires_at = lock
        ok = True
        if op == "rlock":
            if writer is not None:
                ok, outcome = False, "write_held"
            else:
                expires_at = expires_at if ttl is None else ts + ttl
                locked_at = ts if locked_at is None else locked_at
                count, places = readers or (0, {})
                # places only grow, so the last one is the largest
                places.setdefault(holder, []).append(session[2] if session else 0)
                lock = (None, (count + 1, places), locked_at, expires_at)
                session = (ts, expires_at, 1) if session is None else (session[0], session[1], session[2] + 1)
                outcome = "read_locked"
        elif op == "lock":
            if writer is not None or readers:
                ok, outcome = False, "read_held" if readers else "write_held"
            else:
                lock = (holder, None, ts, None if ttl is None else ts + ttl)
                outcome = "write_locked"
        elif readers and holder in readers[1]:
            gone = len(readers[1].pop(holder))
            lock = (None, (readers[0] - gone, readers[1]), locked_at, expires_at) if readers[0] > gone else FREE
            if lock is FREE:
                self._close(session, ts, "unlock", emit)
                session = None
            outcome = "read_released"
        elif writer is not None and writer == holder:
            lock, outcome = FREE, "write_released"
        else:
            ok, outcome = False, "not_holder"
        if self.emits == "outcomes":
            emit((seq, ts, op, holder, ok, outcome, self._count(lock), lock[0], lock[3]))
        elif ok:
            self._level(ts, lock, emit)
        return (lock, session)

    def summary(self, rows):
        times = [r[2] for r in rows]
        n, nothing = len(rows), [].append
        silent = RWMutexFold("outcomes")
        free = [None] * n + [self.start()]  # the state at the end, if the lock is free before row i
        unlocks: dict = {}  # holder -> the next row that unlocks for it
        for i in range(n - 1, -1, -1):
            op, holder, ts, ttl, _ = rows[i]
            free[i] = free[i + 1]
            if op == "lock":
                expires = None if ttl is None else ts + ttl
                late = n if expires is None else bisect_right(times, expires, i + 1)
                unlock = unlocks.get(holder, n)
                if unlock < late:
                    free[i] = free[unlock + 1]
                elif late < n:
                    free[i] = free[late]
                else:
                    free[i] = ((holder, None, ts, expires), None)
            elif op == "rlock":
                state = silent.start()
                for t in range(i, n):
                    if state[0][3] is not None and state[0][3] < times[t]:
                        free[i] = free[t]
                        break
                    state = silent.step(state, rows[t], nothing)
                    if state[0] == FREE:
                        free[i] = free[t + 1]
                        break
                else:
                    free[i] = state
            else:
                unlocks[holder] = i
        # readers that join an entering session, if it lasts
        joined, count, renewed, expires, lapse = {}, 0, None, None, None
        emptied = []  # rows that leave no joined reader: (row, instant, state at the end if free after it)
        alone = set()  # unlocking rows with no joined reader behind them
        for t, (op, holder, ts, ttl, _) in enumerate(rows):
            if expires is not None and expires < ts:
                lapse = t
                break
            if op == "rlock":
                joined.setdefault(holder, []).append(count)
                count += 1
                if ttl is not None:
                    expires = ts + ttl
                    renewed = t if renewed is None else renewed
            elif op != "lock":
                if joined.pop(holder, None) and not joined:
                    emptied.append((t, ts, free[t + 1]))
                if not joined:
                    alone.add(t)
        ends = []
        for i, ts in enumerate(times):
            if ends and ends[-1][1] == free[i]:
                ends[-1] = (ts, free[i])
            else:
                ends.append((ts, free[i]))
        return {
            "free": free[0], "ends": ends, "leaves": {h: (t, times[t], free[t + 1], t in alone) for h, t in unlocks.items()},
            "emptied": emptied, "joined": joined, "count": count, "expires": expires,
            "renewed": None if renewed is None else (renewed, times[renewed]), "lapse": None if lapse is None else (lapse, free[lapse])}

    def through(self, summary, state):
        lock, session = state
        if lock == FREE:
            return _copied(summary["free"])
        writer, readers, locked_at, expires = lock
        ends, leaves = summary["ends"], summary["leaves"]
        runs_out = expires is not None and expires < ends[-1][0]
        if readers is None:
            left = leaves.get(writer)
            if left is not None and (expires is None or left[1] <= expires):
                return _copied(left[2])
            return _copied(ends[bisect_right(ends, expires, key=lambda e: e[0])][1]) if runs_out else state
        # when the last reader is gone, if the session lasts
        gone = None
        if all(h in leaves for h in readers[1]):
            last = max(leaves[h] for h in readers[1])
            gone = last[:3] if last[3] else next((e for e in summary["emptied"] if e[0] > last[0]), None)
        # the entering expiry counts until a joining reader renews it
        renewed, lapse = summary["renewed"], summary["lapse"]
        if runs_out and (renewed is None or expires < renewed[1]):
            if gone is None or gone[1] > expires:
                return _copied(ends[bisect_right(ends, expires, key=lambda e: e[0])][1])
        elif lapse is not None and (gone is None or gone[0] >= lapse[0]):
            return _copied(lapse[1])
        if gone is not None:
            return _copied(gone[2])
        places = {h: list(p) for h, p in readers[1].items() if h not in leaves}
        for h, own in summary["joined"].items():
            places.setdefault(h, []).extend(session[2] + p for p in own)
        held = (None, (sum(map(len, places.values())), places), locked_at, expires if summary["expires"] is None else summary["expires"])
        return (held, (session[0], session[1], session[2] + summary["count"]))

    def finish(self, state, emit, end):
        now = self.as_of_us if end is None else end
        if now is not None:
            state = self.expire(state, now, emit)
        lock, session = state
        self._close(session, None, "open", emit)
        if self.emits == "status":
            order = sorted((at, holder) for holder, places in (lock[1] or (0, {}))[1].items() for at in places)
            emit((lock[0], ",".join(holder for _, holder in order) or None, lock[2], lock[3]))


def _copied(state):
    """A state of its own: readers are changed in place."""
    (writer, readers, locked_at, expires), session = state
    if readers is not None:
        readers = (readers[0], {h: list(p) for h, p in readers[1].items()})
    return ((writer, readers, locked_at, expires), session)


def _composed(ops: DataFrame, fold: RWMutexFold, times: list[str], only_last: bool = False) -> DataFrame:
    return as_timestamps(composed_fold(with_micros(ops), KEY, ORDER, fold, only_last), times)


def rwmutex_replay(ops: DataFrame) -> DataFrame:
    """R2: the outcome of every operation and the lock as it is afterwards."""
    return _composed(ops, RWMutexFold("outcomes"), ["ts", "expires_at"])


def rwmutex_status(ops: DataFrame, as_of: str) -> DataFrame:
    """Writer, readers and phase; expiry clears all holders at once."""
    fold = RWMutexFold("status", _as_of_us(as_of))
    out = _composed(_until(ops, as_of), fold, ["locked_at", "expires_at"], only_last=True)
    phase = (
        F.when(F.col("writer").isNotNull(), "WriteLocked")
        .when(F.col("readers").isNotNull(), "ReadLocked").otherwise("Unlocked"))
    return out.withColumn("phase", phase)


def rw_reader_timeline(ops: DataFrame, as_of: str | None = None) -> DataFrame:
    """Readers and writer after every change, expiries included."""
    return _composed(_until(ops, as_of), RWMutexFold("levels", _as_of_us(as_of)), ["ts"])


def reader_peaks(timeline: DataFrame) -> DataFrame:
    """Most concurrent read locks, and how often each side got in."""
    return timeline.groupBy(*KEY).agg(
        F.max("readers").alias("peak_readers"), F.count_if(F.col("writer").isNotNull()).alias("write_changes"))


def rw_conflicts(intervals: DataFrame) -> DataFrame:
    """Reported holds that began inside an incompatible earlier one; a hold without an end goes on.

    Two running maxima, the furthest end of the earlier writes and of the earlier reads, tell
    every such hold in linear size; pairs are never enumerated.
    """
    by_end = F.struct("end_at", "holder")
    scanned = ordered_scan(with_open_ends(intervals), KEY, ["start_at", "seq"], {
        "__w": Prefix("max", F.when(F.col("mode") == "write", by_end), inclusive=False),
        "__r": Prefix("max", F.when(F.col("mode") == "read", by_end), inclusive=False),
    })
    in_write = F.coalesce(F.col("__w.end_at") > F.col("start_at"), F.lit(False))
    in_read = F.coalesce((F.col("__r.end_at") > F.col("start_at")) & (F.col("mode") == "write"), F.lit(False))
    return scanned.filter(in_write | in_read).select(
        *KEY, "seq", "mode", "holder", "start_at",
        in_write.alias("inside_write"), in_read.alias("inside_read"),
        F.when(in_write, F.col("__w.holder")).alias("writer"),
        F.when(in_read, F.col("__r.holder")).alias("reader"))


def rw_ttl_extension(ops: DataFrame, as_of: str | None = None) -> DataFrame:
    """Read sessions, and how far later readers pushed the shared expiry."""
    fold = RWMutexFold("sessions", _as_of_us(as_of))
    out = _composed(_until(ops, as_of), fold, ["started_at", "first_expiry", "ended_at"])
    beyond = F.greatest(F.lit(0), seconds_between("first_expiry", "ended_at"))
    return out.withColumn("extended_seconds", F.when(F.col("ended_at").isNotNull(), beyond))


def writer_starvation(replay: DataFrame) -> DataFrame:
    """Per writer, refusals by readers from the first one until its next success."""
    writes = replay.filter("op = 'lock'")
    by = [*KEY, "holder"]
    later = ordered_scan(writes, by, ORDER, {
        "locked_at": Prefix("last", F.when(F.col("ok"), F.col("ts")), inclusive=False, reverse=True)})
    refused = later.filter("outcome = 'read_held'")
    return refused.groupBy(*by, "locked_at").agg(
        F.count(F.lit(1)).alias("refusals"), F.min("ts").alias("first_refused_at")).withColumn(
        "delay_seconds", seconds_between("first_refused_at", "locked_at"))
