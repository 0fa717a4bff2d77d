"""Leases and leader election."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from coordlytics.functions.columns import expiry, instant, lock_live, none_if_empty, seconds_between
from coordlytics.operators.mutex import _as_of_us, _until, as_timestamps, fields, with_micros
from coordlytics.operators.relations import KEY
from coordlytics.plans.ordered import BUCKET_UNIT, Fold, Prefix, ordered_fold, ordered_scan

#: The end of what has not ended.
FAR = "timestamp '9999-01-01 00:00:00'"


def given_priority():
    return F.coalesce("priority", F.lit(0))


def lease_arbitration(leases: DataFrame, requests: DataFrame, include_granted: bool) -> DataFrame:
    """L1: the request that wins each lease: highest priority, then the earliest.

    A minimum over (priority, time, seq), so every task first reduces its rows to one per lease.
    """
    competing = requests if include_granted else requests.filter(
        F.col("phase").isNull() | (F.col("phase") != "Granted"))
    best = F.min_by(
        F.struct("holder", given_priority().alias("priority"), "requested_at", "seq"),
        F.struct(-given_priority(), "requested_at", "seq")).alias("best")
    winners = competing.groupBy("ns", F.col("lease").alias("name")).agg(best)
    return leases.select(*KEY).join(winners, KEY).select(*KEY, "best.*")


def lease_status(leases: DataFrame, requests: DataFrame, as_of: str) -> DataFrame:
    """L2: expire, free and grant in that order; an expired lease is never reported as such."""
    now = instant(as_of)
    alive = lock_live(now) & none_if_empty("holder").isNotNull()
    current = leases.select(
        *KEY, "ttl", F.when(alive, F.struct("holder", "acquired_at", "expires_at")).alias("held"))
    asked = requests.filter(F.col("requested_at") <= now)
    winners = lease_arbitration(current.filter("held is null"), asked, include_granted=True)
    granted = F.col("winner").isNotNull()
    return (
        current.join(winners.select(*KEY, F.col("holder").alias("winner")), KEY, "left")
        .select(
            *KEY, F.coalesce("held.holder", "winner").alias("holder"),
            F.coalesce("held.acquired_at", F.when(granted, now)).alias("acquired_at"),
            F.coalesce("held.expires_at", F.when(granted, expiry(now, F.col("ttl")))).alias("expires_at"),
            F.when(F.col("held").isNotNull() | granted, "Held").otherwise("Available").alias("phase")))


class LeaseFold(Fold):
    """Grants over a log of requests and clears.

    Requests of one priority are served in order and numbered beforehand, so the queue of a
    priority is a list of ranges of ordinals, a new one wherever the ttl asked for changes. A grant
    names the priority and the ordinal, and lasts as long as that request asked for; the request
    itself is joined back afterwards. State forgets everything once nobody waits.
    """

    inputs = ["op", "priority", "ts_us", "ttl_us", "ordinal"]
    output = fields("priority long,ordinal long,started_at long,ended_at long,end_reason string")

    def __init__(self, as_of_us: int | None = None):
        self.as_of_us = as_of_us

    def start(self):
        return (None, {})

    def due(self, state):
        return None if state[0] is None else state[0][3]

    def expire(self, state, now, emit):
        held, waiting = state
        while held is not None and held[3] is not None and held[3] < now:
            emit((held[0], held[1], held[2], held[3], "ttl"))
            held, waiting = self._grant(waiting, held[3])
        return (held, waiting)

    @staticmethod
    def _grant(waiting, at):
        if not waiting:
            return None, waiting
        best = max(waiting)
        (head, tail, ttl), *others = waiting[best]
        rest = {p: r for p, r in waiting.items() if p != best}
        if head < tail:
            rest[best] = ((head + 1, tail, ttl), *others)
        elif others:
            rest[best] = tuple(others)
        return (best, head, at, None if ttl is None or ttl <= 0 else at + ttl), rest

    @staticmethod
    def _queued(ranges, ordinal, ttl):
        if ranges and ranges[-1][2] == ttl:
            return (*ranges[:-1], (ranges[-1][0], ordinal, ttl))
        return (*ranges, (ordinal, ordinal, ttl))

    def step(self, state, row, emit):
        op, priority, ts, ttl, ordinal = row
        held, waiting = self.expire(state, ts, emit)
        if op == "request":
            waiting = {**waiting, priority: self._queued(waiting.get(priority, ()), ordinal, ttl)}
            if held is None:
                held, waiting = self._grant(waiting, ts)
        elif held is not None:
            emit((held[0], held[1], held[2], ts, "clear"))
            held, waiting = self._grant(waiting, ts)
        return (held, waiting)

    def finish(self, state, emit, end):
        held = (state if self.as_of_us is None else self.expire(state, self.as_of_us, emit))[0]
        if held is not None:
            emit((held[0], held[1], held[2], None, "open"))


def lease_tenures(events: DataFrame, as_of: str | None = None) -> DataFrame:
    """L3: every tenure, granted by priority among those pending when the lease became free.

    A tenure lasts as long as its own request asked for. Who is granted depends on all grants
    before, also over silences, as long as anyone waits: the log of one lease is one stream, read
    once; different leases are read side by side.
    """
    log = _until(events, as_of).withColumn("priority", given_priority().cast("long"))
    numbered = ordered_scan(
        log.filter("op = 'request'"), [*KEY, "priority"], ["ts", "seq"], {"ordinal": Prefix("sum", F.lit(1))}
    ).withColumn("ordinal", F.col("ordinal").cast("long"))
    steps = numbered.unionByName(log.filter("op <> 'request'"), allowMissingColumns=True)
    grants = ordered_fold(with_micros(steps), KEY, ["ts", "seq"], LeaseFold(_as_of_us(as_of)))
    grants = as_timestamps(grants, ["started_at", "ended_at"])
    asked = numbered.select(*KEY, "priority", "ordinal", "holder", F.col("ts").alias("requested_at"), "seq")
    return grants.join(asked, [*KEY, "priority", "ordinal"]).drop("ordinal")


def recorded_tenures(status_log: DataFrame, as_of: str | None = None) -> DataFrame:
    """L3 from what was recorded: every tenure in a log of status rows, with nothing simulated.

    ``status_log`` has ns, name, ts, seq, holder (null or empty: nobody) and expires_at (null: never) as written after each change. A
    row of the same holder before the recorded expiry renews its tenure. A tenure ends when its last expiry
    passes, or with the first row that names another holder or none; an expiry at the instant of a row is a renewal in time.
    ``as_of`` ends tenures whose expiry lies before it. Two scans of the log's order, however long a lease's log is.
    """
    order = ["ts", "seq"]
    log = _until(status_log, as_of).select(*KEY, *order, none_if_empty("holder").alias("holder"), "expires_at")
    last = log.groupBy(*KEY).agg(F.max_by("expires_at", F.struct(*order)).alias("__expires"))
    before = ordered_scan(log, KEY, order, {"__b": Prefix("prev", F.struct("holder", "expires_at"))})
    lapsed = F.coalesce(F.col("__b.expires_at") < F.col("ts"), F.lit(False))
    goes_on = F.col("__b.holder").eqNullSafe(F.col("holder")) & (F.col("holder").isNull() | ~lapsed)
    edges = before.filter(F.col("__b").isNull() | ~goes_on)
    # the row before an edge has the last expiry of the tenure that the edge ends
    ended = ordered_scan(edges, KEY, order, {
        "__next": Prefix("prev", F.struct("ts", "holder", F.col("__b.expires_at").alias("expires_at")), reverse=True)})
    tenures = ended.filter("holder is not null").join(last, KEY)
    expires = F.when(F.col("__next").isNull(), F.col("__expires")).otherwise(F.col("__next.expires_at"))
    limit = F.col("__next.ts") if as_of is None else F.coalesce("__next.ts", instant(as_of))
    lapses = F.coalesce(expires < limit, F.lit(False))
    reason = (
        F.when(lapses, "ttl").when(F.col("__next").isNull(), "open")
        .when(F.col("__next.holder").isNull(), "clear").otherwise("handover"))
    return tenures.select(
        *KEY, "holder", "seq", F.col("ts").alias("started_at"), F.when(lapses, expires).otherwise(F.col("__next.ts")).alias("ended_at"),
        reason.alias("end_reason"))


def pending_requests(requests: DataFrame, as_of: str) -> DataFrame:
    """L4: ungranted requests with their place in the queue and their age."""
    now = instant(as_of)
    waiting = (
        requests.filter((F.col("requested_at") <= now) & (F.col("phase").isNull() | (F.col("phase") != "Granted")))
        .withColumnRenamed("lease", "name").withColumn("__p", -given_priority()))
    queued = ordered_scan(waiting, KEY, ["__p", "requested_at", "seq"], {"position": Prefix("sum", F.lit(1))},
                          bucket=F.struct("__p", F.date_trunc(BUCKET_UNIT, "requested_at")))
    depth = waiting.groupBy(*KEY).agg(F.count(F.lit(1)).alias("queue_length"))
    return queued.join(depth, KEY).select(
        *KEY, "holder", "seq", (-F.col("__p")).alias("priority"), F.col("position").cast("long").alias("position"),
        "queue_length", seconds_between("requested_at", now).alias("age_seconds"))


def leader_at(events: DataFrame, tenures: DataFrame) -> DataFrame:
    """Who held the lease when each event happened.

    Tenures of a lease do not overlap, so the last one started decides: a union and one
    running value instead of a range join.
    """
    starts = tenures.select(*KEY, F.col("started_at").alias("ts"), F.lit(-1).cast("long").alias("seq"),
                            F.struct("holder", "ended_at").alias("tenure"))
    # a tenure that begins at the event's instant counts, so its row sorts first
    rows = starts.unionByName(events.select(*KEY, "ts", "seq", F.lit(None).alias("tenure")))
    # two tenures can start at one instant when the first ends at once; the later end is current
    known = ordered_scan(rows.withColumn("__end", F.coalesce("tenure.ended_at", F.lit("9999-01-01").cast("timestamp"))),
                         KEY, ["ts", "seq", "__end"], {"current": Prefix("last", F.col("tenure"))})
    inside = F.col("current.ended_at").isNull() | (F.col("ts") < F.col("current.ended_at"))
    return known.filter("seq >= 0").select(*KEY, "ts", "seq", F.when(inside, F.col("current.holder")).alias("leader"))


def heartbeat_sessions(heartbeats: DataFrame, keys: list[str] = [*KEY, "holder"]) -> DataFrame:
    """Reigns built from repeated renewals; a silence longer than the ttl ends one.

    A renewal at the very instant of expiry still continues the reign.
    """
    order = ["ts", "seq"]
    alive_until = ordered_scan(heartbeats, keys, order, {"__until": Prefix("prev", F.col("ts") + F.col("ttl"))}, more=True)
    new = F.when(F.col("__until").isNull() | (F.col("__until") < F.col("ts")), 1).otherwise(0)
    numbered = ordered_scan(alive_until, keys, order, {"__reign": Prefix("sum", new)})
    return numbered.groupBy(*keys, "__reign").agg(
        F.min("ts").alias("started_at"), F.max(F.col("ts") + F.col("ttl")).alias("ended_at"),
        (F.count(F.lit(1)) - 1).alias("renew_count")).drop("__reign")


def leader_changes(tenures: DataFrame, flapping_from: int = 3) -> DataFrame:
    """Handovers, the gaps without a leader, and leases that change hands often."""
    order = ["started_at", "seq"]
    before = ordered_scan(tenures, KEY, order, {"__b": Prefix("prev", F.struct("holder", "ended_at"))})
    moved = F.col("__b.holder") != F.col("holder")
    gap = seconds_between("__b.ended_at", "started_at")
    return before.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("tenures"), F.count_if(moved).alias("handovers"),
        F.max(gap).alias("max_gap_seconds"), F.coalesce(F.sum(gap), F.lit(0)).alias("total_gap_seconds"),
        (F.count_if(moved) >= flapping_from).alias("flapping"))


def overlapping_runs(runs: DataFrame) -> DataFrame:
    """Runs of a singleton job that began before an earlier one had ended; one without an end still runs."""
    seen = ordered_scan(runs, KEY, ["start_at", "seq"], {
        "__busy": Prefix("max", F.coalesce("end_at", F.expr(FAR)), inclusive=False)})
    busy_until = F.when(F.col("__busy") < F.expr(FAR), F.col("__busy"))
    return seen.filter(F.col("__busy") > F.col("start_at")).select(
        *KEY, "holder", "seq", "start_at", "end_at", busy_until.alias("busy_until"))
