"""Registered queries for the eight primitives, each with plain SQL for the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from coordlytics.operators import barrier, gate, lease, mutex, once, rwmutex, semaphore, waits, waitgroup
from coordlytics.plans.bindings import EVENT_AS_OF, ORDER_AS_OF, Tables
from coordlytics.plans.catalog import Entry, with_tables

ORDER_NOW = f"timestamp '{ORDER_AS_OF}'"
EVENT_NOW = f"timestamp '{EVENT_AS_OF}'"
SECONDS = "floor((epoch_us({1}) - epoch_us({0})) / 1000000.0)::bigint"


LEASES_FROM = "timestamp '1992-01-01 00:00:00'"


def secs(start: str, end: str) -> str:
    return SECONDS.format(start, end)


# ------------------------------------------------------------------ shared frames


def arrival_steps(t: Tables) -> DataFrame:
    """Arrivals as +1; holder 4 withdraws twenty days later."""
    firsts = barrier.first_arrivals(t.arrivals())
    gone = firsts.filter("holder = '4'").withColumn("arrived_at", F.expr("arrived_at + make_dt_interval(20)"))
    plus, minus = F.lit(1).cast("long").alias("delta"), F.lit(-1).cast("long").alias("delta")
    cols = ["ns", "name", F.col("arrived_at").alias("ts")]
    return firsts.select(*cols, plus).unionByName(gone.select(*cols, minus))


def permit_spans(t: Tables) -> DataFrame:
    return t.permits().select("ns", F.col("semaphore").alias("name"), "holder", "acquired_at", F.col("expires_at").alias("ended_at"))


def timeline(t: Tables) -> DataFrame:
    return semaphore.in_use_timeline(permit_spans(t), spans=True)


def wanted_conditions(t: Tables) -> DataFrame:
    return t.raw("customer").selectExpr(
        "'default' as ns", "cast(c_custkey as string) as name",
        "explode(array(cast(c_nationkey as string), if(c_custkey % 5 = 0, 'nowhere', cast(c_nationkey as string)))) as condition")


def held_leases(t: Tables) -> DataFrame:
    """A third of the leases have run out, a third are held, the others were never taken."""
    k = "cast(name as int) % 3"
    return t.leases().selectExpr(
        "ns", "name", "ttl", f"case when {k} < 2 then 'sys' end as holder",
        f"case when {k} < 2 then {ORDER_NOW} - make_dt_interval(2) end as acquired_at",
        f"case {k} when 0 then {ORDER_NOW} - make_dt_interval(1) when 1 then {ORDER_NOW} end as expires_at")


def tenures(t: Tables) -> DataFrame:
    return lease.lease_tenures(t.lease_log(), EVENT_AS_OF)


def reported_rw(t: Tables) -> DataFrame:
    return t.runs().filter("holder in ('view', 'click')").withColumn(
        "mode", F.when(F.col("holder") == "view", "read").otherwise("write")).withColumn(
        "holder", F.concat(F.lit("h"), (F.col("seq") % 3).cast("string")))


def resources(t: Tables) -> DataFrame:
    return (
        gate.resource_status("Barrier", barrier.barrier_status(t.barriers(), t.arrivals(), ORDER_AS_OF))
        .unionByName(gate.resource_status("Semaphore", semaphore.semaphore_status(t.semaphores(), t.permits(), ORDER_AS_OF)))
        .unionByName(gate.resource_status("Lease", lease.lease_status(held_leases(t), t.lease_requests(), ORDER_AS_OF)))
        .unionByName(gate.resource_status("Job", t.jobs())))


def conditions(t: Tables) -> DataFrame:
    return gate.gate_conditions(t.gates(), resources(t))


def opened(t: Tables) -> DataFrame:
    return barrier.barrier_opened_at(t.barriers(), t.arrivals())


def stages(t: Tables) -> DataFrame:
    """The orders of one customer are the stages of a pipeline, by order key."""
    return t.raw("orders").selectExpr(
        "'default' as ns", "cast(o_custkey as string) as pipeline", "o_orderkey as stage", "cast(o_orderkey as string) as name")


def condition_times(t: Tables) -> DataFrame:
    """When each condition of a gate first came true, whatever its type."""
    first = gate.first_met(t.gates(), dependency_changes(t))
    return gate.ruled_conditions(t.gates()).join(first, gate.RULE, "left").select("ns", "name", "pos", "met_at")


def dependency_changes(t: Tables) -> DataFrame:
    """Barriers opening, permits coming and going, leases running out and jobs finishing, as status changes."""
    def shape(df, kind, succeeded="cast(null as bigint)"):
        return df.select(
            F.lit(kind).alias("type"), F.col("ns").alias("target_ns"), F.col("name").alias("condition"),
            "ts", F.lit(0).cast("long").alias("seq"), "phase", "available", F.expr(succeeded).alias("succeeded"))

    opens = opened(t).filter("opened_at is not null").selectExpr("ns", "name", "opened_at as ts", "'Open' as phase", "cast(null as bigint) as available")
    spec = t.semaphores().select("ns", "name", "permits")
    # a permit of no semaphore joins none; said here, it is the same for all that read these levels, and they share a shuffle
    levels = semaphore.in_use_timeline(permit_spans(t).filter("name is not null")).join(spec, ["ns", "name"]).selectExpr("ns", "name", "ts", "cast(null as string) as phase", "permits - in_use as available")
    # a lease is taken and runs out; one never taken is available from the first day on
    held = held_leases(t).selectExpr("ns", "name", "explode(array(named_struct('ts', acquired_at, 'phase', 'Held'), "
        f"named_struct('ts', coalesce(expires_at, {LEASES_FROM}), 'phase', 'Available'))) as c").selectExpr(
        "ns", "name", "c.ts as ts", "c.phase as phase", "cast(null as bigint) as available").filter("ts is not null")
    done = t.raw("orders").selectExpr(
        "'default' as ns", "cast(o_orderkey as string) as name", "cast(o_orderdate as timestamp) as ts",
        "cast(null as string) as phase", "cast(null as bigint) as available", "if(o_orderstatus = 'F', 1L, 0L) as succeeded")
    return (
        shape(opens, "Barrier").unionByName(shape(levels, "Semaphore")).unionByName(shape(held, "Lease"))
        .unionByName(shape(done, "Job", "succeeded")))


def evaluations(t: Tables) -> DataFrame:
    return t.raw("events").filter("event_type <> 'error'").selectExpr(
        "'default' as ns", "cast(user_id as string) as name", "cast(ts as timestamp) as ts", "event_id as seq",
        "if(value >= 20, 'Open', 'Waiting') as phase")


def overrides(t: Tables) -> DataFrame:
    return t.raw("events").filter("event_type = 'error'").selectExpr(
        "'default' as ns", "cast(user_id as string) as name", "cast(ts as timestamp) as ts", "event_id as seq",
        "if(event_id % 2 = 0, 'Open', 'Waiting') as phase")


def waiters(t: Tables) -> DataFrame:
    return t.arrivals().selectExpr(
        "ns", "barrier as name", "arrived_at as ts", "seq", "make_dt_interval(45) as timeout")


def barrier_transitions(t: Tables) -> DataFrame:
    return opened(t).selectExpr(
        "ns", "name", "coalesce(opened_at, deadline) as ts", "if(opened_at is null, 'Failed', 'Open') as phase", "0L as seq").filter("ts is not null")


def updates(t: Tables) -> DataFrame:
    return t.raw("events").selectExpr(
        "'default' as ns", "cast(user_id as string) as name", "cast(floor(event_id / 500) as bigint) as base_version",
        "concat(event_type, '/', cast(floor(event_id / 2000) as bigint)) as update_id",
        "cast(ts as timestamp) as ts", "event_id as seq")


# ------------------------------------------------------------------ shared relations in SQL

EXTRA: dict[str, str] = {
    "arrival_steps": """
      select barrier as name, arrived_at as ts, 1 as delta from arrivals
      union all select barrier, arrived_at + interval 20 day, -1 from arrivals where holder = '4'""",
    "barrier_points": """
      select name, ts, rank, sum(delta) as delta, required, deadline,
        row_number() over (partition by name order by ts, rank) as rn
      from (
        select o.name, greatest(s.ts, o.created_at) as ts, 0 as rank, s.delta, o.required, o.deadline
        from arrival_steps s join opened o on s.name = o.name
        union all select name, created_at, 0, 0, required, deadline from opened
        union all select name, deadline, 1, 0, required, deadline from opened where deadline is not null)
      group by name, ts, rank, required, deadline""",
    "barrier_walk": """
      select name, 0::bigint as rn, null::timestamp as ts, 0::hugeint as arrived, ''::varchar as phase,
        null::timestamp as opened_at from (select distinct name from barrier_points)
      union all
      select name, rn, ts, arrived,
        case when past and arrived < required then 'Failed' when past then phase
             when arrived >= required then 'Open' else 'Waiting' end,
        case when not past and arrived >= required then coalesce(opened_at, ts) else opened_at end
      from (select w.name, p.rn, p.ts, p.required, w.arrived + p.delta as arrived, w.phase, w.opened_at,
              coalesce(p.ts > p.deadline or (p.ts = p.deadline and p.rank = 1), false) as past
            from barrier_walk w join barrier_points p on p.name = w.name and p.rn = w.rn + 1)""",
    "use_net": """
      select semaphore as name, ts, sum(d) as d from (
        select semaphore, acquired_at as ts, 1 as d from permits
        union all select semaphore, expires_at, -1 from permits) group by all""",
    "use_line": """
      select name, ts, d, sum(d) over (partition by name order by ts)::bigint as in_use from use_net""",
    "timeline": """
      select name, ts, in_use, lead(ts) over (partition by name order by ts) as until from use_line where d <> 0""",
    "permit_steps": """
      select *, row_number() over (partition by name, holder order by ts, d, seq) as rn from (
        select semaphore as name, holder, acquired_at as ts, 1 as d, seq from permits
        union all select semaphore, holder, expires_at, -1, seq from permits)""",
    "permit_walk": """
      select name, holder, 0::bigint as rn, null::timestamp as ts, 0 as d, 0::bigint as c, 0::bigint as opens, 0::bigint as closes, false as hit
      from (select distinct name, holder from permit_steps)
      union all
      select w.name, w.holder, p.rn, p.ts, p.d, greatest(0, w.c + p.d),
        w.opens + case when p.d = 1 then 1 else 0 end, w.closes + case when p.d = -1 and w.c > 0 then 1 else 0 end,
        p.d = 1 or w.c > 0
      from permit_walk w join permit_steps p on p.name = w.name and p.holder = w.holder and p.rn = w.rn + 1""",
    "permit_pairs": """
      select a.name, a.holder, a.ts as acquired_at, r.ts as released_at, a.ts + interval 30 day as expires_at,
        least(coalesce(r.ts, a.ts + interval 30 day), a.ts + interval 30 day) as ended_at
      from permit_walk a left join permit_walk r
        on r.name = a.name and r.holder = a.holder and r.d = -1 and r.hit and r.closes = a.opens
      where a.d = 1""",
    "held_leases": f"""
      select name, case when name::int % 3 < 2 then 'sys' end as holder,
        case when name::int % 3 < 2 then {ORDER_NOW} - interval 2 day end as acquired_at,
        case name::int % 3 when 0 then {ORDER_NOW} - interval 1 day when 1 then {ORDER_NOW} end as expires_at
      from leases""",
    "lease_now": f"""
      select l.name, case when l.expires_at >= {ORDER_NOW} then l.holder else w.holder end as holder,
        case when l.expires_at >= {ORDER_NOW} then l.acquired_at when w.holder is not null then {ORDER_NOW} end as acquired_at,
        case when l.expires_at >= {ORDER_NOW} then l.expires_at when w.holder is not null then {ORDER_NOW} + interval 1 day end as expires_at
      from held_leases l left join (
        select lease, holder from lease_requests where requested_at <= {ORDER_NOW}
        qualify row_number() over (partition by lease order by priority desc, requested_at, seq) = 1) w on w.lease = l.name""",
    "lease_requests_log": f"select * from lease_log where op = 'request' and ts <= {EVENT_NOW}",
    "lease_clears": f"select * from lease_log where op = 'clear' and ts <= {EVENT_NOW}",
    "lease_walk": """
      select name, 0 as step, timestamp '1970-01-01' as free_at, []::bigint[] as granted, null::bigint as seq,
        null::timestamp as started_at, null::timestamp as cleared_at
      from (select distinct name from lease_requests_log)
      union all
      select p.name, p.step, least(p.started_at + interval 6 hour, coalesce(p.cleared_at, p.started_at + interval 6 hour)),
        list_append(p.granted, p.seq), p.seq, p.started_at, p.cleared_at
      from (
        select n.name, n.step, n.granted, n.w.seq as seq, n.started_at, min(c.ts) as cleared_at
        from (
          select w.name, w.step + 1 as step, w.granted,
            min({'late': case when r.ts <= w.free_at then 0 else 1 end,
                 'rank': case when r.ts <= w.free_at then -r.priority else 0 end, 'ts': r.ts, 'seq': r.seq}) as w,
            greatest(w.free_at, min({'late': case when r.ts <= w.free_at then 0 else 1 end,
                 'rank': case when r.ts <= w.free_at then -r.priority else 0 end, 'ts': r.ts, 'seq': r.seq}).ts) as started_at
          from lease_walk w join lease_requests_log r on r.name = w.name and not list_contains(w.granted, r.seq)
          group by w.name, w.step, w.granted, w.free_at) n
        left join lease_clears c on c.name = n.name and c.ts > n.started_at and c.ts <= n.started_at + interval 6 hour
        group by n.name, n.step, n.granted, n.w, n.started_at) p""",
    "lease_tenures": f"""
      select w.name, r.holder, r.priority, r.ts as requested_at, w.seq, w.started_at,
        case when w.cleared_at is not null then w.cleared_at when w.started_at + interval 6 hour < {EVENT_NOW} then w.started_at + interval 6 hour end as ended_at,
        case when w.cleared_at is not null then 'clear' when w.started_at + interval 6 hour < {EVENT_NOW} then 'ttl' else 'open' end as end_reason
      from lease_walk w join lease_log r on r.seq = w.seq where w.step > 0 and w.started_at <= {EVENT_NOW}""",
    "recorded_tenures": f"""
      with log as (select user_id::varchar as name, ts, event_id as seq, nullif(event_type, 'purchase') as holder, ts + interval 6 hour as expires_at
                   from events where ts <= {EVENT_NOW}),
        paired as (select *, row_number() over w as rn, lag(holder) over w as bh, lag(expires_at) over w as be,
                     last_value(expires_at) over (partition by name order by ts, seq rows between unbounded preceding and unbounded following) as final
                   from log window w as (partition by name order by ts, seq)),
        edges as (select *, lead(ts) over w as nt, lead(holder) over w as nh, lead(be) over w as ne, lead(rn) over w as nn
                  from paired where rn = 1 or bh is distinct from holder or (holder is not null and be < ts)
                  window w as (partition by name order by ts, seq)),
        ending as (select *, case when nn is null then final else ne end as expires from edges where holder is not null)
      select name, holder, seq, ts as started_at,
        case when expires < coalesce(nt, {EVENT_NOW}) then expires else nt end as ended_at,
        case when expires < coalesce(nt, {EVENT_NOW}) then 'ttl' when nn is null then 'open' when nh is null then 'clear' else 'handover' end as end_reason
      from ending""",
    "mutex_seq": "select *, row_number() over (partition by name order by ts, seq) as rn from mutex_ops",
    "mutex_walk": """
      select name, 0::bigint as rn, null::timestamp as ts, null::bigint as seq, null::varchar as op, null::varchar as who,
        null::varchar as h, null::timestamp as la, null::varchar as h0, null::timestamp as la0
      from (select distinct name from mutex_seq)
      union all
      select name, rn, ts, seq, op, who,
        case when op = 'lock' then coalesce(h0, who) when h0 = who then null else h0 end,
        case when op = 'lock' then coalesce(la0, ts) when h0 = who then null else la0 end, h0, la0
      from (select o.name, o.rn, o.ts, o.seq, o.op, o.holder as who,
              case when w.la + interval 12 hour < o.ts then null else w.h end as h0,
              case when w.la + interval 12 hour < o.ts then null else w.la end as la0
            from mutex_walk w join mutex_seq o on o.name = w.name and o.rn = w.rn + 1)""",
    "mutex_replay": """
      select name, ts, seq, op, who as holder, (op = 'lock' and h0 is null) or (op = 'unlock' and coalesce(h0 = who, false)) as ok,
        case when op = 'lock' and h0 is null then 'acquired' when op = 'lock' then 'locked' when h0 = who then 'released' else 'not_holder' end as outcome,
        case when op = 'lock' then h0 end as blocked_by,
        case when op = 'lock' and h0 is null then ts when op = 'unlock' and h0 = who then la0 end as locked_at
      from mutex_walk where rn > 0""",
    "mutex_tenures": f"""
      select a.name, a.holder, a.ts as locked_at, a.ts + interval 12 hour as expires_at,
        case when r.ts is not null then r.ts when a.ts + interval 12 hour < {EVENT_NOW} then a.ts + interval 12 hour end as ended_at,
        case when r.ts is not null then 'unlock' when a.ts + interval 12 hour < {EVENT_NOW} then 'ttl' else 'open' end as end_reason
      from mutex_replay a left join mutex_replay r
        on r.name = a.name and r.outcome = 'released' and r.locked_at = a.ts and r.ts <= {EVENT_NOW}
      where a.outcome = 'acquired' and a.ts <= {EVENT_NOW}""",
    "rw_seq": "select *, row_number() over (partition by name order by ts, seq) as rn from rwmutex_ops",
    "rw_walk": """
      select name, 0::bigint as rn, null::timestamp as ts, null::bigint as seq, null::varchar as op, null::varchar as who,
        null::varchar as w, []::varchar[] as r, null::timestamp as ex, null::timestamp as la, ''::varchar as outcome,
        null::timestamp as expired_at, null::timestamp as first_ex, null::timestamp as sess, 0 as nr
      from (select distinct name from rw_seq)
      union all
      select name, rn, ts, seq, op, who,
        case when outcome = 'write_locked' then who when outcome = 'write_released' then null else w end,
        case when outcome = 'read_locked' then list_append(r, who) when outcome = 'read_released' then list_filter(r, lambda x: x <> who) else r end,
        case when outcome in ('read_locked', 'write_locked') then ts + interval 12 hour
             when outcome = 'write_released' or (outcome = 'read_released' and len(list_filter(r, lambda x: x <> who)) = 0) then null else ex end,
        case when outcome = 'write_locked' then ts when outcome = 'read_locked' then coalesce(la, ts)
             when outcome = 'write_released' or (outcome = 'read_released' and len(list_filter(r, lambda x: x <> who)) = 0) then null else la end,
        outcome, expired_at,
        case when outcome = 'read_locked' and len(r) = 0 then ts + interval 12 hour else first_ex end,
        case when outcome = 'read_locked' and len(r) = 0 then ts when len(r) = 0 then null else sess end,
        case when outcome = 'read_locked' and len(r) = 0 then 1 when outcome = 'read_locked' then nr + 1 else nr end
      from (select s.*, case
              when op = 'rlock' and w is not null then 'write_held' when op = 'rlock' then 'read_locked'
              when op = 'lock' and len(r) > 0 then 'read_held' when op = 'lock' and w is not null then 'write_held'
              when op = 'lock' then 'write_locked' when list_contains(r, who) then 'read_released'
              when w = who then 'write_released' else 'not_holder' end as outcome
            from (select o.name, o.rn, o.ts, o.seq, o.op, o.holder as who,
                    case when p.ex < o.ts then null else p.w end as w, case when p.ex < o.ts then [] else p.r end as r,
                    case when p.ex < o.ts then null else p.ex end as ex, case when p.ex < o.ts then null else p.la end as la,
                    case when p.ex < o.ts then p.ex end as expired_at, p.first_ex, p.sess, p.nr
                  from rw_walk p join rw_seq o on o.name = p.name and o.rn = p.rn + 1) s)""",
    "counter_seq": "select *, row_number() over (partition by name order by ts, seq) as rn from deltas",
    "counter_walk": """
      select name, 0::bigint as rn, null::timestamp as ts, null::bigint as seq, 0::bigint as delta, 0::bigint as counter, 0::bigint as lost
      from (select distinct name from counter_seq)
      union all
      select c.name, c.rn, c.ts, c.seq, c.delta, greatest(0, w.counter + c.delta), greatest(0, -(w.counter + c.delta))
      from counter_walk w join counter_seq c on c.name = w.name and c.rn = w.rn + 1""",
    "winners": """select name, arg_min(executor, {'ts': ts, 'seq': seq}) as executor, min(ts) as executed_at,
      arg_min(seq, {'ts': ts, 'seq': seq}) as win_seq from claims where ok group by name""",
    "barrier_now": f"""
      select o.name, coalesce(c.n, 0) as arrived, o.required::bigint as required,
        case when o.opened_at <= {ORDER_NOW} then 'Open' when o.deadline < {ORDER_NOW} then 'Failed' else 'Waiting' end as phase,
        case when o.opened_at <= {ORDER_NOW} then o.opened_at end as opened_at, o.expected, o.quorum
      from opened o left join (select barrier, count(*) as n from arrivals where arrived_at <= {ORDER_NOW} group by barrier) c
        on c.barrier = o.name where o.created_at <= {ORDER_NOW}""",
    "semaphore_now": f"""
      select s.name, s.permits, coalesce(p.n, 0) as in_use, s.permits - coalesce(p.n, 0) as available,
        case when s.permits > coalesce(p.n, 0) then 'Ready' else 'Full' end as phase
      from semaphores s left join (
        select semaphore, count(*) as n from permits where acquired_at <= {ORDER_NOW} and expires_at > {ORDER_NOW} group by semaphore) p
        on p.semaphore = s.name""",
    "checked": """
      select c.gate as name, c.pos, c.type, c.cname as condition,
        case c.type when 'Barrier' then coalesce(b.phase = 'Open', false) when 'Lease' then coalesce(l.holder is null and l.name is not null, false)
          when 'Semaphore' then coalesce(s.available >= c.value, false) else coalesce(j.succeeded > 0, false) end as met,
        case c.type
          when 'Barrier' then case when b.name is null then 'Barrier not found' when b.phase = 'Open' then 'Barrier is open' else 'Barrier is not open' end
          when 'Lease' then case when l.name is null then 'Lease not found' when l.holder is null then 'Lease is available' else 'Lease is not available' end
          when 'Semaphore' then case when s.name is null then 'Semaphore not found' when s.available >= c.value then 'Semaphore has required permits' else 'Semaphore does not have required permits' end
          else case when j.name is null then 'Job not found' when j.succeeded > 0 then 'Job completed successfully' else 'Job not in required state' end end as message
      from conditions c
        left join barrier_now b on c.type = 'Barrier' and b.name = c.cname
        left join lease_now l on c.type = 'Lease' and l.name = c.cname
        left join semaphore_now s on c.type = 'Semaphore' and s.name = c.cname
        left join jobs j on c.type = 'Job' and j.name = c.cname""",
    "gate_now": f"""
      select g.name, coalesce(c.met, 0) as conditions_met, coalesce(c.total, 0) as conditions_total,
        case when coalesce(c.met, 0) = coalesce(c.total, 0) then 'Open' when g.deadline < {ORDER_NOW} then 'Failed' else 'Waiting' end as phase
      from gates g left join (select name, count(*) as total, count(*) filter (met) as met from checked group by name) c on c.name = g.name""",
    "closure_steps": """
      select name, depends_on as dependency, 1 as depth from nested_gates
      union
      select c.name, e.depends_on, c.depth + 1 from closure_steps c join nested_gates e on e.name = c.dependency
      where c.depth < (select count(*) from nested_gates)""",
    "closure": "select name, dependency, min(depth) as depth from closure_steps group by all",
    "waits": f"""
      select a.*, t.opened_at, t.deadline from (
        select l_orderkey::varchar as name, l_shipdate as ts, l_linenumber::bigint as seq from lineitem) a
      left join opened t on t.name = a.name""",
    "wait_ends": """
      select name, ts, seq, phase, done_at from (
        select w.*, coalesce(opened_at, deadline) as done_at, case when opened_at is not null then 'opened' when deadline is not null then 'failed' end as phase from waits w)""",
    "outcomes": """
      select name, ts, seq,
        case when done_at <= ts + interval 45 day then phase else 'timeout' end as outcome,
        case when done_at <= ts then 0 when done_at <= ts + interval 45 day then """ + secs("ts", "done_at") + """ else 45 * 86400 end::bigint as wait_seconds
      from wait_ends""",
    "attempts": """
      select user_id::varchar as name, event_id // 500 as base_version, event_type || '/' || (event_id // 2000) as update_id, ts, event_id as seq,
        case when row_number() over (partition by user_id, event_id // 500 order by ts, event_id) = 1 then 'applied' else 'conflict' end as outcome
      from events""",
    "rw_intervals": """
      select name, 'h' || (seq % 3) as holder, case when holder = 'view' then 'read' else 'write' end as mode, start_at, end_at, seq
      from runs where holder in ('view', 'click')""",
    "merged_runs": """
      select name, holder, min(start_at) as start_at, max(end_at) as end_at, min(seq) as seq from (
        select *, sum(case when reach >= start_at then 0 else 1 end) over (partition by name, holder order by start_at, seq) as island from (
          select *, max(end_at) over (partition by name, holder order by start_at, seq rows between unbounded preceding and 1 preceding) as reach from runs))
      group by name, holder, island""",
    "phase_log": """
      select user_id::varchar as name, ts, event_id as seq,
        case when event_type = 'error' then case when event_id % 2 = 0 then 'Open' else 'Waiting' end
             else case when value >= 20 then 'Open' else 'Waiting' end end as phase,
        case when event_type = 'error' then 'override' else 'evaluation' end as source
      from events""",
    "rules": "select distinct type, cname, value from conditions",
    "rule_state": """
      select 'Barrier' as type, name as cname, null::int as value, opened_at as ts, true as met from opened where opened_at is not null
      union all
      select r.type, r.cname, r.value, t.ts, s.permits - t.in_use >= r.value
      from rules r join timeline t on r.type = 'Semaphore' and t.name = r.cname join semaphores s on s.name = r.cname
      union all select 'Lease', name, null, acquired_at, false from held_leases where acquired_at is not null
      union all select 'Lease', name, null, coalesce(expires_at, """ + LEASES_FROM + """), true from held_leases
      union all select 'Job', o_orderkey::varchar, null, o_orderdate, o_orderstatus = 'F' from orders""",
    "rule_flips": """
      select type, cname, ts, case when met then 1 else -1 end as d from (
        select *, lag(met, 1, false) over (partition by type, cname, value order by ts) as before from rule_state)
      where met <> before""",
    "gate_rows": """
      select name, ts, sum(d) as d, total from (
        select c.gate as name, greatest(f.ts, timestamp '1998-01-01') as ts, f.d, n.total
        from conditions c join rule_flips f on f.type = c.type and f.cname = c.cname
          join (select gate, count(*) as total from conditions group by gate) n on n.gate = c.gate
        union all
        select g.name, timestamp '1998-01-01', 0, coalesce(n.total, 0) from gates g
          left join (select gate, count(*) as total from conditions group by gate) n on n.gate = g.name)
      group by name, ts, total""",
    "gate_levels": """
      select *, met = total as open from (select name, ts, total, sum(d) over (partition by name order by ts)::bigint as met from gate_rows)""",
}


def entry(run, body: str | None) -> Entry:
    return Entry(run, None if body is None else with_tables(body, EXTRA))


NS = "'default' as ns"

ENTRIES: dict[str, Entry] = {
    # ---- barriers
    "barrier_status": entry(
        lambda t: barrier.barrier_status(t.barriers(), t.arrivals(), ORDER_AS_OF),
        f"select {NS}, name, arrived, required, phase, opened_at from barrier_now"),
    "barrier_opened_at": entry(
        lambda t: opened(t).select("ns", "name", "required", "opened_at"),
        f"select {NS}, name, required, opened_at from opened"),
    "barrier_arrivals": entry(
        lambda t: barrier.barrier_arrivals(t.arrivals()),
        f"select {NS}, barrier as name, pos as position, holder, arrived_at, seq from ranked_arrivals"),
    "barrier_missing": entry(
        lambda t: barrier.barrier_missing(t.roster(), t.arrivals()),
        f"""select {NS}, b.name as barrier, k::varchar as holder
            from (select name, unnest(range(1, expected + 1)) as k from barriers) b
            where not exists (select 1 from arrivals a where a.barrier = b.name and a.holder = b.k::varchar)"""),
    "barrier_phase_timeline": entry(
        lambda t: barrier.barrier_phase_timeline(t.barriers(), arrival_steps(t)),
        f"""select {NS}, name, phase, ts as started_at, lead(ts) over (partition by name order by rn) as ended_at,
              arrived::bigint as arrived, opened_at
            from (select *, lag(phase) over (partition by name order by rn) as before from barrier_walk where rn > 0)
            where before is null or before <> phase"""),
    "barrier_waits": entry(
        lambda t: barrier.barrier_waits(t.barriers(), t.arrivals()),
        f"""select {NS}, o.name, a.holder, a.pos as position, greatest(0, {secs('a.arrived_at', 'o.opened_at')}) as wait_seconds,
              a.pos = o.required as is_last_needed, a.pos > o.required as late
            from ranked_arrivals a join opened o on o.name = a.barrier where o.opened_at is not null"""),
    "barrier_wait_summary": entry(
        lambda t: barrier.barrier_wait_summary(barrier.barrier_waits(t.barriers(), t.arrivals())),
        f"""select {NS}, name, count(*) as waiters, max(w) as max_wait_seconds, quantile_disc(w, 0.5) as p50_wait_seconds,
              arg_max(holder, pos) as last_holder
            from (select o.name, a.holder, a.pos, greatest(0, {secs('a.arrived_at', 'o.opened_at')}) as w
                  from ranked_arrivals a join opened o on o.name = a.barrier where o.opened_at is not null and a.pos <= o.required)
            group by name"""),
    "stage_chain": entry(
        lambda t: barrier.stage_chain(stages(t), opened(t).select("ns", "name", "opened_at", "last_holder")),
        f"""select {NS}, pipeline, stage, name, started_at, opened_at as ended_at, coalesce(missing, 0) > 0 as blocked,
              case when coalesce(missing, 0) = 0 then {secs('started_at', 'opened_at')} end as stage_seconds, last_holder as critical_holder
            from (select o_custkey::varchar as pipeline, o_orderkey as stage, b.name, b.opened_at,
                    case when b.opened_at is not null then a.holder end as last_holder,
                    lag(b.opened_at) over (partition by o_custkey order by o_orderkey) as started_at,
                    sum(case when b.opened_at is null then 1 else 0 end) over (partition by o_custkey order by o_orderkey
                      rows between unbounded preceding and 1 preceding) as missing
                  from orders join opened b on b.name = o_orderkey::varchar
                    left join ranked_arrivals a on a.barrier = b.name and a.pos = b.required)"""),
    "quorum_slack": entry(
        lambda t: barrier.quorum_slack(t.barriers(), t.arrivals(), ORDER_AS_OF),
        f"""select {NS}, name, arrived, greatest(0, expected - arrived)::bigint as outstanding,
              (expected - coalesce(quorum, expected))::bigint as tolerated,
              quorum is not null and phase = 'Open' and arrived < expected as opened_early
            from barrier_now"""),
    # ---- semaphores
    "semaphore_status": entry(
        lambda t: semaphore.semaphore_status(t.semaphores(), t.permits(), ORDER_AS_OF),
        f"select {NS}, name, permits, in_use, available, phase from semaphore_now"),
    "permit_status": entry(
        lambda t: semaphore.permit_status(t.permits(), ORDER_AS_OF).select("ns", "semaphore", "holder", "seq", "counts", "phase"),
        f"""select {NS}, semaphore, holder, seq, expires_at > {ORDER_NOW} as counts,
              case when expires_at > {ORDER_NOW} then 'Granted' end as phase from permits"""),
    "permit_intervals": entry(
        lambda t: semaphore.permit_intervals(t.permit_events()),
        f"""select {NS}, name, holder, acquired_at, released_at, expires_at, ended_at,
              case when released_at <= expires_at then 'release' else 'expiry' end as end_reason from permit_pairs"""),
    "in_use_timeline": entry(
        lambda t: semaphore.in_use_timeline(permit_spans(t)), f"select {NS}, name, ts, in_use from timeline"),
    "oversubscription": entry(
        lambda t: semaphore.oversubscription(timeline(t), t.semaphores()),
        f"""select {NS}, name, island as episode, min(ts) as started_at, max(until) as ended_at, max(excess)::bigint as peak_excess
            from (select *, sum(case when excess > 0 and coalesce(before, 0) <= 0 then 1 else 0 end)
                    over (partition by name order by ts)::bigint as island
                  from (select *, lag(excess) over (partition by name order by ts) as before
                        from (select t.name, t.ts, t.until, t.in_use - s.permits as excess from timeline t join semaphores s on s.name = t.name)))
            where excess > 0 group by name, island"""),
    "peak_concurrency": entry(
        lambda t: semaphore.peak_concurrency(timeline(t), t.semaphores()),
        f"""select {NS}, name, bucket, max(in_use) as peak, sum(s)::bigint as covered_seconds, sum(s * in_use)::bigint as permit_seconds,
              round(sum(s * in_use) / sum(s)::double, 4) as mean_in_use,
              round(sum(s * in_use) / (max(permits) * sum(s))::double, 4) as utilisation
            from (select t.name, b as bucket, t.in_use, p.permits,
                    {secs('greatest(t.ts, b)', "least(t.until, b + interval 1 month)")} as s
                  from (select *, unnest(generate_series(date_trunc('month', ts)::timestamp,
                          date_trunc('month', until - interval 1 microsecond)::timestamp, interval 1 month)) as b
                        from timeline where until is not null) t
                    join semaphores p on p.name = t.name)
            group by name, bucket"""),
    "permit_admission": entry(
        lambda t: semaphore.permit_admission(t.semaphores(), t.permits(), ORDER_AS_OF),
        f"""select {NS}, p.name, p.position, case when p.position <= s.permits then 'Granted' else 'Denied' end as phase, p.acquired_at
            from (select semaphore as name, acquired_at, row_number() over (partition by semaphore order by acquired_at, seq) as position
                  from permits where acquired_at <= {ORDER_NOW} and expires_at > {ORDER_NOW}) p
              join semaphores s on s.name = p.name"""),
    "holder_usage": entry(
        lambda t: semaphore.holder_usage(semaphore.permit_intervals(t.permit_events()), ORDER_AS_OF),
        f"""select {NS}, name, holder, count(*) as permits, count(*) filter (ended_at > {ORDER_NOW}) as open_permits,
              count(*) filter (expires_at <= {ORDER_NOW} and (released_at is null or released_at > {ORDER_NOW})) as stuck_permits,
              max({secs('acquired_at', 'ended_at')}) filter (ended_at <= {ORDER_NOW}) as max_hold_seconds,
              (sum({secs('acquired_at', 'ended_at')}) filter (ended_at <= {ORDER_NOW}))::bigint as total_hold_seconds
            from permit_pairs where acquired_at <= {ORDER_NOW} group by name, holder"""),
    # ---- leases
    "lease_arbitration": entry(
        lambda t: lease.lease_arbitration(t.leases(), t.lease_requests(), include_granted=False),
        f"""select {NS}, lease as name, holder, priority, requested_at, seq from lease_requests where phase is null
            qualify row_number() over (partition by lease order by priority desc, requested_at, seq) = 1"""),
    "lease_status": entry(
        lambda t: lease.lease_status(held_leases(t), t.lease_requests(), ORDER_AS_OF),
        f"""select {NS}, name, holder, acquired_at, expires_at, case when holder is null then 'Available' else 'Held' end as phase from lease_now"""),
    "lease_tenures": entry(
        tenures,
        f"select {NS}, name, holder, priority::bigint as priority, requested_at, seq, started_at, ended_at, end_reason from lease_tenures"),
    "recorded_tenures": entry(
        lambda t: lease.recorded_tenures(t.lease_status_log(), EVENT_AS_OF),
        f"select {NS}, name, holder, seq, started_at, ended_at, end_reason from recorded_tenures"),
    "recorded_leader_at": entry(
        lambda t: lease.leader_at(t.heartbeats(), lease.recorded_tenures(t.lease_status_log(), EVENT_AS_OF)),
        f"""select {NS}, e.name, e.ts, e.seq, l.holder as leader from heartbeats e left join recorded_tenures l
              on l.name = e.name and e.ts >= l.started_at and (l.ended_at is null or e.ts < l.ended_at)"""),
    "recorded_leader_changes": entry(
        lambda t: lease.leader_changes(lease.recorded_tenures(t.lease_status_log(), EVENT_AS_OF)),
        f"""select {NS}, name, count(*) as tenures, count(*) filter (ph <> holder) as handovers,
              max({secs('pe', 'started_at')}) as max_gap_seconds, coalesce(sum({secs('pe', 'started_at')}), 0)::bigint as total_gap_seconds,
              count(*) filter (ph <> holder) >= 3 as flapping
            from (select *, lag(holder) over w as ph, lag(ended_at) over w as pe from recorded_tenures window w as (partition by name order by started_at, seq))
            group by name"""),
    "pending_requests": entry(
        lambda t: lease.pending_requests(t.lease_requests(), ORDER_AS_OF),
        f"""select {NS}, lease as name, holder, seq, priority, row_number() over (partition by lease order by priority desc, requested_at, seq) as position,
              count(*) over (partition by lease) as queue_length, {secs('requested_at', ORDER_NOW)} as age_seconds
            from lease_requests where phase is null and requested_at <= {ORDER_NOW}"""),
    "leader_at": entry(
        lambda t: lease.leader_at(t.heartbeats(), tenures(t)),
        f"""select {NS}, e.name, e.ts, e.seq, l.holder as leader from heartbeats e left join lease_tenures l
              on l.name = e.name and e.ts >= l.started_at and (l.ended_at is null or e.ts < l.ended_at)"""),
    "heartbeat_sessions": entry(
        lambda t: lease.heartbeat_sessions(t.heartbeats()),
        f"""select {NS}, name, holder, min(ts) as started_at, max(ts) + interval 6 hour as ended_at, count(*) - 1 as renew_count
            from (select *, sum(case when before + interval 6 hour >= ts then 0 else 1 end) over (partition by name, holder order by ts, seq) as reign
                  from (select *, lag(ts) over (partition by name, holder order by ts, seq) as before from heartbeats))
            group by name, holder, reign"""),
    "leader_changes": entry(
        lambda t: lease.leader_changes(tenures(t)),
        f"""select {NS}, name, count(*) as tenures, count(*) filter (ph <> holder) as handovers,
              max({secs('pe', 'started_at')}) as max_gap_seconds, coalesce(sum({secs('pe', 'started_at')}), 0)::bigint as total_gap_seconds,
              count(*) filter (ph <> holder) >= 3 as flapping
            from (select *, lag(holder) over w as ph, lag(ended_at) over w as pe from lease_tenures window w as (partition by name order by started_at, seq))
            group by name"""),
    "overlapping_runs": entry(
        lambda t: lease.overlapping_runs(t.runs()),
        f"""select {NS}, name, holder, seq, start_at, end_at, busy_until from (
              select *, max(end_at) over (partition by name order by start_at, seq rows between unbounded preceding and 1 preceding) as busy_until from runs)
            where busy_until > start_at"""),
    # ---- mutexes
    "mutex_status": entry(
        lambda t: mutex.mutex_status(t.mutex_ops(), EVENT_AS_OF),
        f"""select {NS}, name, case when alive then h end as holder, case when alive then la end as locked_at,
              case when alive then la + interval 12 hour end as expires_at, case when alive then 'Locked' else 'Unlocked' end as phase
            from (select name, s.h as h, s.la as la, coalesce(s.la + interval 12 hour >= {EVENT_NOW}, false) as alive
                  from (select name, arg_max({{'h': h, 'la': la}}, rn) as s from mutex_walk where ts <= {EVENT_NOW} group by name))"""),
    "mutex_replay": entry(
        lambda t: mutex.mutex_replay(t.mutex_ops()),
        f"""select {NS}, name, seq, ts, op, holder, ok, outcome, blocked_by, locked_at, locked_at + interval 12 hour as expires_at from mutex_replay"""),
    "mutex_tenures": entry(
        lambda t: mutex.mutex_tenures(t.mutex_ops(), EVENT_AS_OF),
        f"select {NS}, name, holder, locked_at, ended_at, expires_at, end_reason from mutex_tenures"),
    "mutex_rejections": entry(
        lambda t: mutex.mutex_rejections(mutex.mutex_replay(t.mutex_ops())),
        f"select {NS}, name, ts, seq, op, holder, outcome, blocked_by from mutex_replay where not ok"),
    "mutex_contention": entry(
        lambda t: mutex.mutex_contention(mutex.mutex_replay(t.mutex_ops().filter(F.col("ts") <= EVENT_AS_OF)), mutex.mutex_tenures(t.mutex_ops(), EVENT_AS_OF)),
        f"""select {NS}, name, bucket, coalesce(attempts, 0) as attempts, coalesce(acquired, 0) as acquired, coalesce(contenders, 0) as contenders,
              coalesce(held_seconds, 0)::bigint as held_seconds, p50 as p50_hold_seconds, p95 as p95_hold_seconds, round(acquired / attempts::double, 4) as success_rate
            from (select name, date_trunc('day', ts)::timestamp as bucket, count(*) as attempts, count(*) filter (ok) as acquired, count(distinct holder) as contenders
                  from mutex_replay where op = 'lock' and ts <= {EVENT_NOW} group by all) a
            full join (select name, date_trunc('day', locked_at)::timestamp as bucket, quantile_disc(hold, 0.5) as p50, quantile_disc(hold, 0.95) as p95
                  from (select *, {secs('locked_at', 'ended_at')} as hold from mutex_tenures where ended_at is not null) group by all) s using (name, bucket)
            full join (select name, b as bucket, sum({secs('greatest(locked_at, b)', 'least(ended_at, b + interval 1 day)')}) as held_seconds
                  from (select *, unnest(generate_series(date_trunc('day', locked_at)::timestamp, date_trunc('day', ended_at)::timestamp, interval 1 day)) as b
                        from mutex_tenures where ended_at is not null) group by all) u using (name, bucket)"""),
    "wider_contention": entry(
        lambda t: mutex.wider_contention(mutex.contention_sketches(
            mutex.mutex_replay(t.mutex_ops().filter(F.col("ts") <= EVENT_AS_OF)), mutex.mutex_tenures(t.mutex_ops(), EVENT_AS_OF)), "week"),
        f"""select {NS}, name, bucket, coalesce(attempts, 0) as attempts, coalesce(acquired, 0) as acquired, coalesce(contenders, 0) as contenders,
              p50 as p50_hold_seconds, p95 as p95_hold_seconds
            from (select name, date_trunc('week', ts)::timestamp as bucket, count(*) as attempts, count(*) filter (ok) as acquired, count(distinct holder) as contenders
                  from mutex_replay where op = 'lock' and ts <= {EVENT_NOW} group by all) a
            full join (select name, date_trunc('week', locked_at)::timestamp as bucket, quantile_disc(hold, 0.5) as p50, quantile_disc(hold, 0.95) as p95
                  from (select *, {secs('locked_at', 'ended_at')}::bigint as hold from mutex_tenures where ended_at is not null) group by all) s using (name, bucket)"""),
    "exclusion_violations": entry(
        lambda t: mutex.exclusion_violations(t.runs()),
        f"""select {NS}, name, holder, start_at, end_at, far.h as held_by, {secs('start_at', 'least(end_at, far.e)')} as overlap_seconds
            from (select *, max({{'e': end_at, 'h': holder}}) over (partition by name order by start_at, seq rows between unbounded preceding and 1 preceding) as far from merged_runs)
            where far.e > start_at"""),
    "lock_wait_times": entry(
        lambda t: mutex.lock_wait_times(t.lock_requests(), "make_dt_interval(1)"),
        f"""with steps as (
              select *, case when op = 'request' then 1 else -1 end as d, row_number() over (partition by name, holder order by ts, seq) as rn from lock_requests),
            walk as (
              select *, sum(d) over w as s, least(0, min(s0) over w) as low from (
                select *, sum(d) over (partition by name, holder order by rn) as s0 from steps) window w as (partition by name, holder order by rn)),
            numbered as (
              select *, lag(low, 1, 0) over (partition by name, holder order by rn) as low0,
                count(*) filter (d = 1) over (partition by name, holder order by rn) as opens,
                count(*) filter (d = -1) over (partition by name, holder order by rn) + low as closes from walk)
            select {NS}, a.name, a.holder, a.seq, a.ts as requested_at, r.ts as acquired_at,
              case when r.ts <= a.ts + interval 1 day then 'acquired' else 'timeout' end as outcome,
              case when r.ts <= a.ts + interval 1 day then {secs('a.ts', 'r.ts')} end as wait_seconds
            from numbered a left join numbered r on r.name = a.name and r.holder = a.holder and r.d = -1 and r.low = r.low0 and r.closes = a.opens
            where a.d = 1"""),
    # ---- read-write locks
    "rwmutex_status": entry(
        lambda t: rwmutex.rwmutex_status(t.rwmutex_ops(), EVENT_AS_OF),
        f"""select {NS}, name, case when alive then w end as writer, case when alive then nullif(array_to_string(r, ','), '') end as readers,
              case when alive then la end as locked_at, case when alive then ex end as expires_at,
              case when not alive then 'Unlocked' when w is not null then 'WriteLocked' when len(r) > 0 then 'ReadLocked' else 'Unlocked' end as phase
            from (select name, s.w as w, s.r as r, s.la as la, s.ex as ex, coalesce(s.ex >= {EVENT_NOW}, false) as alive
                  from (select name, arg_max({{'w': w, 'r': r, 'la': la, 'ex': ex}}, rn) as s from rw_walk where ts <= {EVENT_NOW} group by name))"""),
    "rwmutex_replay": entry(
        lambda t: rwmutex.rwmutex_replay(t.rwmutex_ops()),
        f"""select {NS}, name, seq, ts, op, who as holder, outcome in ('read_locked', 'write_locked', 'read_released', 'write_released') as ok, outcome,
              len(r) as readers, w as writer, ex as expires_at from rw_walk where rn > 0"""),
    "rw_reader_timeline": entry(
        lambda t: rwmutex.rw_reader_timeline(t.rwmutex_ops(), EVENT_AS_OF),
        f"""select {NS}, name, ts, len(r) as readers, w as writer from rw_walk
            where outcome in ('read_locked', 'write_locked', 'read_released', 'write_released') and ts <= {EVENT_NOW}
            union all select 'default', name, expired_at, 0, null from rw_walk where expired_at is not null and ts <= {EVENT_NOW}
            union all select 'default', name, s.ex, 0, null from (select name, arg_max({{'ex': ex}}, rn) as s from rw_walk where ts <= {EVENT_NOW} group by name)
              where s.ex < {EVENT_NOW}"""),
    "reader_peaks": entry(
        lambda t: rwmutex.reader_peaks(rwmutex.rw_reader_timeline(t.rwmutex_ops())),
        f"""select {NS}, name, max(len(r)) as peak_readers, count(*) filter (w is not null and outcome = 'write_locked') as write_changes
            from rw_walk where outcome in ('read_locked', 'write_locked', 'read_released', 'write_released') group by name"""),
    "rw_conflicts": entry(
        lambda t: rwmutex.rw_conflicts(reported_rw(t)),
        f"""select {NS}, name, seq, mode, holder, start_at, in_w as inside_write, in_r as inside_read,
              case when in_w then fw.h end as writer, case when in_r then fr.h end as reader
            from (select *, coalesce(fw.e > start_at, false) as in_w, coalesce(fr.e > start_at and mode = 'write', false) as in_r
                  from (select *, max({{'e': end_at, 'h': holder}}) filter (mode = 'write') over w as fw,
                          max({{'e': end_at, 'h': holder}}) filter (mode = 'read') over w as fr
                        from rw_intervals window w as (partition by name order by start_at, seq rows between unbounded preceding and 1 preceding)))
            where in_w or in_r"""),
    "rw_ttl_extension": entry(
        lambda t: rwmutex.rw_ttl_extension(t.rwmutex_ops(), EVENT_AS_OF),
        f"""with rows as (
              select name, rn, ts, ex, len(r) as n, sess, first_ex, nr, outcome,
                lead(expired_at) over (partition by name order by rn) as next_expired, lead(rn) over (partition by name order by rn) as next_rn,
                lag(sess) over (partition by name order by rn) as sess0, lag(first_ex) over (partition by name order by rn) as first0, lag(nr) over (partition by name order by rn) as nr0
              from rw_walk where ts <= {EVENT_NOW}),
            ends as (
              select name, sess0 as started_at, first0 as first_expiry, ts as ended_at, 'unlock' as end_reason, nr0 as read_locks from rows where outcome = 'read_released' and n = 0
              union all
              select name, sess, first_ex, case when next_rn is not null then next_expired when ex < {EVENT_NOW} then ex end,
                case when next_rn is not null or ex < {EVENT_NOW} then 'ttl' else 'open' end, nr
              from rows where n > 0 and (next_expired is not null or next_rn is null))
            select {NS}, name, started_at, first_expiry, ended_at, end_reason, read_locks::bigint as read_locks,
              greatest(0, {secs('first_expiry', 'ended_at')}) + case when ended_at is null then null else 0 end as extended_seconds
            from ends"""),
    "writer_starvation": entry(
        lambda t: rwmutex.writer_starvation(rwmutex.rwmutex_replay(t.rwmutex_ops())),
        f"""select {NS}, name, who as holder, next_ok as locked_at, count(*) as refusals, min(ts) as first_refused_at, {secs('min(ts)', 'next_ok')} as delay_seconds
            from (select *, min(case when outcome = 'write_locked' then ts end) over (partition by name, who order by ts, seq rows between 1 following and unbounded following) as next_ok
                  from rw_walk where op = 'lock')
            where outcome = 'read_held' group by name, who, next_ok"""),
    # ---- run once
    "once_winner": entry(
        lambda t: once.once_winner(t.claims()), f"select {NS}, name, executor, executed_at, win_seq from winners"),
    "once_attempts": entry(
        lambda t: once.once_attempts(t.claims()),
        f"""select {NS}, c.name, c.executor, c.ts, c.seq, case
              when w.name is null or c.ts < w.executed_at or (c.ts = w.executed_at and c.seq < w.win_seq) then 'failed_rolled_back'
              when c.ts = w.executed_at and c.seq = w.win_seq then 'executed' else 'skipped_already_executed' end as outcome
            from claims c left join winners w on w.name = c.name"""),
    "once_status": entry(
        lambda t: once.once_status(t.onces(), t.claims(), EVENT_AS_OF),
        f"""select {NS}, o.name, w.name is not null as executed, w.executor, w.executed_at, case when w.name is null then 'Pending' else 'Executed' end as phase
            from onces o left join (select name, arg_min(executor, ts) as executor, min(ts) as executed_at from claims where ok and ts <= {EVENT_NOW} group by name) w on w.name = o.name
            where o.created_at <= {EVENT_NOW} and {EVENT_NOW} <= o.created_at + interval 7 day"""),
    "once_pending": entry(
        lambda t: once.once_pending(t.onces(), t.claims()).select("ns", "name", "created_at"),
        f"select {NS}, name, created_at from onces where name not in (select name from claims where ok)"),
    "duplicate_executions": entry(
        lambda t: once.duplicate_executions(t.claims().filter("ok")),
        f"select {NS}, name, count(*) as executions from claims where ok group by name having count(*) > 1"),
    # ---- wait groups
    "waitgroup_counter": entry(
        lambda t: waitgroup.waitgroup_counter(t.deltas()),
        f"select {NS}, name, ts, seq, delta, counter, lost from counter_walk where rn > 0"),
    "waitgroup_status": entry(
        lambda t: waitgroup.waitgroup_status(t.waitgroups(), t.deltas(), EVENT_AS_OF),
        f"""select {NS}, c_custkey::varchar as name, coalesce(k, 0) as counter, case when coalesce(k, 0) <= 0 then 'Done' else 'Waiting' end as phase
            from customer left join (select name, arg_max(counter, rn) as k from counter_walk where ts <= {EVENT_NOW} group by name) w on w.name = c_custkey::varchar"""),
    "waitgroup_episodes": entry(
        lambda t: waitgroup.waitgroup_episodes(t.deltas()),
        f"""select {NS}, name, min(ts) as started_at, max(ts) filter (counter = 0) as done_at, max(counter) as peak,
              {secs('min(ts)', 'max(ts) filter (counter = 0)')} as duration_seconds
            from (select *, sum(case when counter > 0 and before = 0 then 1 else 0 end) over (partition by name order by rn) as episode
                  from (select *, lag(counter) over (partition by name order by rn) as before from counter_walk) where rn > 0)
            where counter > 0 or before > 0 group by name, episode"""),
    "lost_dones": entry(
        lambda t: waitgroup.lost_dones(t.deltas()),
        f"select {NS}, name, ts, seq, delta, counter, lost from counter_walk where rn > 0 and lost > 0"),
    # ---- gates
    "gate_conditions": entry(
        lambda t: conditions(t).select("ns", "name", "type", "condition", "met", "message"),
        f"select {NS}, name, type, condition, met, message from checked"),
    "gate_status": entry(
        lambda t: gate.gate_status(t.gates(), conditions(t), ORDER_AS_OF),
        f"select {NS}, name, conditions_met, conditions_total, phase from gate_now"),
    "gate_progress": entry(
        lambda t: gate.gate_progress(conditions(t)).withColumn("unmet", F.array_join("unmet", ",")),
        f"""select {NS}, name, count(*) filter (met) as conditions_met, count(*) as conditions_total,
              coalesce(string_agg(type || '/' || condition, ',' order by pos) filter (not met), '') as unmet from checked group by name"""),
    "gate_opened_at": entry(
        lambda t: gate.gate_opened_at(t.gates(), condition_times(t)),
        f"""select {NS}, g.name, case when coalesce(c.all_met, true) then greatest(coalesce(c.last, timestamp '1998-01-01'), timestamp '1998-01-01') end as opened_at
            from gates g left join (
              select c.gate, bool_and(f.met_at is not null) as all_met, max(f.met_at) as last
              from conditions c left join (select type, cname, min(ts) as met_at from rule_flips where d = 1 group by type, cname) f
                on f.type = c.type and f.cname = c.cname group by c.gate) c on c.gate = g.name"""),
    "gate_subset_ready": entry(
        lambda t: gate.gate_subset_ready(gate.gate_conditions(t.gates(), resources(t), wanted_conditions(t)), wanted_conditions(t)),
        f"""select {NS}, c_custkey::varchar as name, c_custkey % 5 <> 0 and coalesce(m.met, false) as ready
            from customer left join (select name, condition, arg_max(met, pos) as met from checked group by name, condition) m
              on m.name = c_custkey::varchar and m.condition = c_nationkey::varchar"""),
    "gate_overrides": entry(
        lambda t: gate.gate_overrides(evaluations(t), overrides(t)),
        f"select {NS}, name, ts, seq, phase, source, lead(ts) over (partition by name order by ts, seq) as until from phase_log"),
    "gate_closure": entry(
        lambda t: gate.gate_closure(t.nested_gates()), f"select {NS}, name, dependency, depth from closure"),
    "closure_summary": entry(
        lambda t: gate.closure_summary(gate.gate_closure(t.nested_gates()), t.nested_gates()),
        f"""select {NS}, name, count(*) as dependencies, max(depth)::bigint as depth, bool_or(name = dependency) as in_cycle,
              count(*) filter (dependency not in (select name from nested_gates)) as root_blockers from closure group by name"""),
    "gate_history": entry(
        lambda t: gate.gate_history(t.gates(), dependency_changes(t)),
        f"""select {NS}, name, open, ts as started_at, lead(ts) over (partition by name order by ts) as ended_at, met as conditions_met
            from (select *, lag(open) over (partition by name order by ts) as before from gate_levels)
            where before is null or before <> open"""),
    # ---- waiters and updates
    "wait_outcomes": entry(
        lambda t: waits.wait_outcomes(waiters(t), barrier_transitions(t)),
        f"select {NS}, name, ts, seq, outcome, wait_seconds from outcomes"),
    "update_conflicts": entry(
        lambda t: waits.update_conflicts(updates(t)),
        f"select {NS}, name, base_version, update_id, ts, seq, outcome from attempts"),
    "update_retries": entry(
        lambda t: waits.update_retries(waits.update_conflicts(updates(t))),
        f"""select {NS}, name, update_id, count(*) as tries, count(*) filter (outcome = 'conflict') as conflicts, bool_or(outcome = 'applied') as applied,
              not bool_or(outcome = 'applied') and count(*) >= 10 as exhausted from attempts group by name, update_id"""),
    "wait_percentiles": entry(
        lambda t: waits.wait_percentiles(
            waits.wait_outcomes(waiters(t), barrier_transitions(t)).join(t.barriers().select("ns", "name", "expected"), ["ns", "name"]), ["ns", "expected"]),
        f"""select {NS}, b.expected, count(*) filter (outcome = 'opened') as opened, count(*) filter (outcome = 'failed') as failed,
              count(*) filter (outcome = 'timeout') as timeout, quantile_disc(wait_seconds, 0.5) as p50, quantile_disc(wait_seconds, 0.95) as p95,
              quantile_disc(wait_seconds, 0.99) as p99
            from outcomes o join barriers b on b.name = o.name group by b.expected"""),
}
