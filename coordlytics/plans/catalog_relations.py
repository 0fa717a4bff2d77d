"""Registered queries for readers, shared column rules, validation and reports."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from coordlytics.functions import columns as C
from coordlytics.operators import barrier, gate, mutex, once, relations, report, rwmutex, semaphore, validate, waitgroup, lease
from coordlytics.plans import catalog_primitives as P
from coordlytics.plans.bindings import EVENT_AS_OF, ORDER_AS_OF, Tables
from coordlytics.plans.catalog import Entry
from coordlytics.plans.durable import cut, fresh_path
from coordlytics.sources.specs import SPEC_SCHEMAS, read_clustered, write_clustered
from coordlytics.plans.catalog_primitives import EVENT_NOW, NS, ORDER_NOW, entry, secs


def duration_texts(t: Tables) -> DataFrame:
    """Duration texts of several forms, one in five malformed."""
    return t.raw("events").selectExpr(
        "event_id",
        """case event_id % 5 when 0 then concat(event_id % 50, 'h', event_id % 60, 'm')
             when 1 then concat(value, 's') when 2 then concat(event_id % 1000, 'ms', event_id % 999, 'us')
             when 3 then concat(event_id % 9000, 'ns') else concat(event_id % 7, 'm ', event_id % 5, 's') end as ttl""")


def clustered_requests(t: Tables) -> DataFrame:
    """IO3 over a clustered table: the label and the time bound are compared in the files."""
    requests, path = t.lease_requests(), fresh_path(t.spark, "requests")
    write_clustered(requests, path, ["lease"], time="requested_at", unit="year")
    rows = read_clustered(t.spark, path, SPEC_SCHEMAS["lease_request"], ["lease"], since="1995-01-01", time="requested_at", unit="year")
    return relations.list_kind(rows, "default", {"lease": "7"}).select("ns", "lease", "holder", "priority", "requested_at", "seq")


def loose_barriers(t: Tables) -> DataFrame:
    """Specs that break every rule somewhere."""
    return t.raw("orders").selectExpr(
        "'default' as ns", "cast(o_orderkey as string) as name",
        "case when o_orderkey % 11 > 0 then cast(o_orderkey % 6 as int) end as expected",
        "case when o_orderkey % 2 = 0 then cast(o_orderkey % 9 as int) end as quorum",
        "case when o_orderkey % 7 = 0 then 'soon' when o_orderkey % 3 = 0 then '1h' end as timeout",
        """concat('{"ns": "default", "expected": 1', if(o_orderkey % 10 = 0, ', "maxRetries": 3', ''), '}') as raw""")


def loose_gates(t: Tables) -> DataFrame:
    return t.raw("nation").selectExpr(
        "'default' as ns", "cast(n_nationkey as string) as name",
        """case when n_nationkey % 5 = 0 then array() else array(named_struct(
             'type', if(n_nationkey % 5 = 1, 'Cron', 'Job'), 'name', if(n_nationkey % 5 = 2, '', n_name),
             'namespace', '', 'state', if(n_nationkey % 5 = 3, 'Great', 'Complete'), 'value', 1)) end as conditions""",
        "'5m' as timeout")


def unnamed(t: Tables) -> DataFrame:
    return t.raw("events").selectExpr(
        "event_id", "cast(ts as timestamp) as ts",
        "if(event_id % 3 = 0, '', if(event_id % 3 = 1, null, event_type)) as holder",
        "if(event_id % 2 = 0, '', concat('host', user_id)) as hostname",
        "if(event_id % 4 = 0, '', if(event_id % 4 = 1, null, 'own')) as ns",
        "if(event_id % 8 < 4, '', 'parent') as parent_ns")


def short_permits(t: Tables) -> DataFrame:
    return t.raw("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "cast(l_shipdate as timestamp) as acquired_at",
        "case when l_linenumber % 3 = 0 then make_dt_interval(cast(l_quantity as int)) when l_linenumber % 3 = 1 then make_dt_interval(0) end as ttl")


def creates(t: Tables) -> DataFrame:
    return t.events(kind="event_type", holder="concat('h', event_id % 3)", op="'create'")


def user_permits(t: Tables) -> DataFrame:
    """Events as permits of the semaphore that has the user's number; many users have none."""
    return t.raw("events").selectExpr(
        "'default' as ns", "cast(user_id as string) as semaphore", "event_type as holder", "cast(ts as timestamp) as acquired_at", "event_id as seq")


def phase_log(t: Tables) -> DataFrame:
    return P.evaluations(t).unionByName(P.overrides(t))


def transition_source(t: Tables) -> DataFrame:
    """Phase logs of two kinds: gates as evaluated, wait groups as counted."""
    gates = phase_log(t).select(F.lit("Gate").alias("kind"), "ns", "name", "ts", "seq", "phase")
    groups = waitgroup.waitgroup_counter(t.deltas()).select(
        F.lit("WaitGroup").alias("kind"), "ns", "name", "ts", "seq",
        F.when(F.col("counter") > 0, "Waiting").otherwise("Done").alias("phase"))
    return gates.unionByName(groups)


def everything(t: Tables) -> DataFrame:
    """T1 over the eight kinds."""
    k = ["ns", "name", "phase"]
    sem = semaphore.semaphore_status(t.semaphores(), t.permits(), ORDER_AS_OF)
    bar = barrier.barrier_status(t.barriers(), t.arrivals(), ORDER_AS_OF)
    held = lease.lease_status(P.held_leases(t), t.lease_requests(), ORDER_AS_OF)
    known = (
        gate.resource_status("Barrier", bar).unionByName(gate.resource_status("Semaphore", sem))
        .unionByName(gate.resource_status("Lease", held)).unionByName(gate.resource_status("Job", t.jobs())))
    return report.status_all(
        Semaphore=sem.select(*k, F.col("in_use").alias("used"), F.col("permits").alias("total")),
        Barrier=bar.select(*k, F.col("arrived").alias("used"), F.col("required").alias("total")),
        Lease=held.select(*k, "holder"),
        Gate=gate.gate_status(t.gates(), gate.gate_conditions(t.gates(), known), ORDER_AS_OF).select(
            *k, F.col("conditions_met").alias("used"), F.col("conditions_total").alias("total")),
        Mutex=mutex.mutex_status(t.mutex_ops(), EVENT_AS_OF).select(*k, "holder"),
        RWMutex=rwmutex.rwmutex_status(t.rwmutex_ops(), EVENT_AS_OF).select(*k, F.col("writer").alias("holder")),
        Once=once.once_status(t.onces(), t.claims(), EVENT_AS_OF).select(*k, F.col("executor").alias("holder")),
        WaitGroup=waitgroup.waitgroup_status(t.waitgroups(), t.deltas(), EVENT_AS_OF).select(*k, F.col("counter").alias("used")))


def known_resources(t: Tables) -> DataFrame:
    """The kind of every resource there is, without any status: what a count per kind needs."""
    now = F.lit(ORDER_AS_OF).cast("timestamp")
    onces = once.once_status(t.onces(), t.claims().limit(0), EVENT_AS_OF)
    of = {
        "Semaphore": t.semaphores(), "Barrier": t.barriers().filter(F.col("created_at") <= now), "Lease": t.leases(),
        "Gate": t.raw("customer"), "Once": onces, "WaitGroup": t.waitgroups(),
        **{kind: ops.filter(F.col("ts") <= EVENT_AS_OF).select("ns", "name").distinct()
           for kind, ops in (("Mutex", t.mutex_ops()), ("RWMutex", t.rwmutex_ops()))}}
    parts = [df.select(F.lit(kind).alias("kind")) for kind, df in of.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def deadlines(t: Tables) -> DataFrame:
    """Deadlines of permits, barriers, gates, leases and locks in one shape."""
    permits = t.permits().filter(F.col("acquired_at") <= ORDER_AS_OF).selectExpr(
        "'Permit' as kind", "ns", "concat(semaphore, '/', holder) as name", "expires_at as deadline").distinct()
    barriers = P.opened(t).filter(f"created_at <= {ORDER_NOW} and (opened_at is null or opened_at > {ORDER_NOW})").selectExpr(
        "'Barrier' as kind", "ns", "name", "deadline")
    gates = t.gates().selectExpr("'Gate' as kind", "ns", "name", "created_at + timeout as deadline")
    leases = lease.lease_status(P.held_leases(t), t.lease_requests(), ORDER_AS_OF).selectExpr(
        "'Lease' as kind", "ns", "name", "expires_at as deadline")
    mutexes = mutex.mutex_status(t.mutex_ops(), EVENT_AS_OF).selectExpr("'Mutex' as kind", "ns", "name", "expires_at as deadline")
    rwmutexes = rwmutex.rwmutex_status(t.rwmutex_ops(), EVENT_AS_OF).selectExpr("'RWMutex' as kind", "ns", "name", "expires_at as deadline")
    parts = [permits, barriers, gates, leases, mutexes, rwmutexes]
    return functools.reduce(DataFrame.unionByName, parts)


def gate_listing(t: Tables) -> DataFrame:
    checked = cut(P.conditions(t))
    return report.status_detail("gate", gate.gate_status(t.gates(), checked, ORDER_AS_OF), checked)


def lease_children(t: Tables) -> DataFrame:
    return lease.pending_requests(t.lease_requests(), ORDER_AS_OF)


MICROS = """case event_id % 5 when 0 then (event_id % 50) * 3600000000 + (event_id % 60) * 60000000
  when 1 then round(value * 1000000)::bigint when 2 then (event_id % 1000) * 1000 + event_id % 999
  when 3 then (event_id % 9000) // 1000 end"""

EVERYTHING = """
  select 'Semaphore' as kind, 'default' as ns, name, phase, in_use::bigint as used, permits::bigint as total, null::varchar as holder from semaphore_now
  union all select 'Barrier', 'default', name, phase, arrived, required, null from barrier_now
  union all select 'Lease', 'default', name, case when holder is null then 'Available' else 'Held' end, null, null, coalesce(holder, 'Available') from lease_now
  union all select 'Gate', 'default', name, phase, conditions_met, conditions_total, null from gate_now
  union all select 'Mutex', 'default', name, case when alive then 'Locked' else 'Unlocked' end, null, null, case when alive then h end
    from (select name, s.h as h, coalesce(s.la + interval 12 hour >= {e}, false) as alive
          from (select name, arg_max({{'h': h, 'la': la}}, rn) as s from mutex_walk where ts <= {e} group by name))
  union all select 'RWMutex', 'default', name, case when not alive then 'Unlocked' when w is not null then 'WriteLocked' when len(r) > 0 then 'ReadLocked' else 'Unlocked' end,
      null, null, case when alive then w end
    from (select name, s.w as w, s.r as r, coalesce(s.ex >= {e}, false) as alive
          from (select name, arg_max({{'w': w, 'r': r, 'ex': ex}}, rn) as s from rw_walk where ts <= {e} group by name))
  union all select 'Once', 'default', o.name, case when w.name is null then 'Pending' else 'Executed' end, null, null, w.executor
    from onces o left join (select name, arg_min(executor, ts) as executor from claims where ok and ts <= {e} group by name) w on w.name = o.name
    where o.created_at <= {e} and {e} <= o.created_at + interval 7 day
  union all select 'WaitGroup', 'default', c_custkey::varchar, case when coalesce(k, 0) <= 0 then 'Done' else 'Waiting' end, coalesce(k, 0), null, null
    from customer left join (select name, arg_max(counter, rn) as k from counter_walk where ts <= {e} group by name) w on w.name = c_custkey::varchar
""".format(e=EVENT_NOW)

ENTRIES: dict[str, Entry] = {
    # ---- readers and relations
    "read_specs": entry(
        lambda t: t.barriers().select("ns", "name", "created_at", "expected", "quorum", (F.col("created_at") + F.col("timeout")).alias("deadline")),
        f"select {NS}, name, created_at, expected, quorum, deadline from barriers"),
    "read_events": entry(
        lambda t: t.events(kind="'lock'", op="event_type", holder="concat('h', event_id % 3)", ttl="make_dt_interval(0, 12)").selectExpr(
            "ns", "kind", "name", "op", "holder", "ts", "seq", "ts + ttl as expires_at"),
        f"""select {NS}, 'lock' as kind, user_id::varchar as name, event_type as op, 'h' || (event_id % 3) as holder, ts, event_id as seq,
              ts + interval 12 hour as expires_at from events"""),
    "list_kind": entry(
        lambda t: relations.list_kind(t.lease_requests(), "default", {"lease": "7"}).select("ns", "lease", "holder", "priority", "requested_at", "seq"),
        f"select {NS}, lease, holder, priority, requested_at, seq from lease_requests where lease = '7'"),
    "list_kind_clustered": entry(
        clustered_requests,
        f"select {NS}, lease, holder, priority, requested_at, seq from lease_requests where lease = '7' and requested_at >= timestamp '1995-01-01'"),
    "children_of": entry(
        lambda t: relations.children_of(t.barriers().select("ns", "name", "expected"), t.arrivals(), "barrier")
        .groupBy("ns", "name", "expected").agg(F.count("child_seq").alias("children"), F.max("child_arrived_at").alias("last")),
        f"""select {NS}, b.name, b.expected, count(l.l_orderkey) as children, max(l.l_shipdate) as last
            from barriers b left join lineitem l on l.l_orderkey::varchar = b.name group by b.name, b.expected"""),
    "orphans": entry(
        lambda t: relations.orphans(t.semaphores(), user_permits(t), "semaphore").select("ns", "semaphore", "holder", "acquired_at", "seq"),
        f"""select {NS}, user_id::varchar as semaphore, event_type as holder, ts as acquired_at, event_id as seq from events
            where not exists (select 1 from semaphores s where s.name = user_id::varchar)"""),
    "label_spec_mismatch": entry(
        lambda t: relations.label_spec_mismatch(
            t.arrivals().withColumn("labels", F.when(F.col("seq") % 3 == 0, F.create_map(F.lit("barrier"), F.col("holder")))
                                    .when(F.col("seq") % 3 == 1, F.col("labels"))), "barrier").select("ns", "barrier", "holder", "arrived_at"),
        f"""select {NS}, l_orderkey::varchar as barrier, l_linenumber::varchar as holder, l_shipdate as arrived_at from lineitem
            where l_linenumber % 3 = 2 or (l_linenumber % 3 = 0 and l_orderkey <> l_linenumber)"""),
    "dedupe_creates": entry(
        lambda t: relations.dedupe_creates(creates(t)).select("ns", "kind", "name", "holder", "ts", "seq"),
        f"""select {NS}, event_type as kind, user_id::varchar as name, 'h' || (event_id % 3) as holder, ts, event_id as seq from events
            qualify row_number() over (partition by event_type, user_id order by ts, event_id) = 1"""),
    "status_changes": entry(
        lambda t: relations.status_changes(phase_log(t), ["phase"]),
        f"""select {NS}, name, ts, seq, phase from (select *, lag(phase) over (partition by name order by ts, seq) as before from phase_log)
            where before is null or before <> phase"""),
    "where_condition": entry(
        lambda t: relations.where_condition(
            semaphore.semaphore_status(t.semaphores(), t.permits(), ORDER_AS_OF), "available > 0 and in_use >= permits / 2"),
        f"select {NS}, name, permits, in_use, available, phase from semaphore_now where available > 0 and in_use >= permits / 2"),
    # ---- column rules
    "parse_durations": entry(
        lambda t: C.parse_durations(duration_texts(t), "ttl").select(
            "event_id", "ttl_valid", F.unix_micros(F.timestamp_micros(F.lit(0)) + F.col("ttl_interval")).alias("micros")),
        f"select event_id, event_id % 5 <> 4 as ttl_valid, {MICROS} as micros from events"),
    "effective_holder": entry(
        lambda t: C.effective_holder(unnamed(t)).select("event_id", "effective_holder"),
        """select event_id, case when event_id % 3 = 2 then event_type when event_id % 2 = 1 then 'host' || user_id
              else 'sdk-' || floor(epoch_us(ts) / 1000000)::bigint end as effective_holder from events"""),
    "effective_namespace": entry(
        lambda t: C.effective_namespace(unnamed(t)).select("event_id", "effective_ns"),
        "select event_id, case when event_id % 4 > 1 then 'own' when event_id % 8 >= 4 then 'parent' else 'default' end as effective_ns from events"),
    "effective_expiry": entry(
        lambda t: C.effective_expiry(short_permits(t)).select("l_orderkey", "l_linenumber", "l_partkey", "expires_at"),
        """select l_orderkey, l_linenumber, l_partkey, case l_linenumber % 3 when 0 then l_shipdate + l_quantity::int * interval 1 day
             when 2 then l_shipdate + interval 10 minute end as expires_at from lineitem"""),
    "is_live": entry(
        lambda t: C.is_live(C.is_live(t.permits(), ORDER_AS_OF, permits=True).withColumnRenamed("live", "counted"), ORDER_AS_OF, permits=False)
        .groupBy("semaphore").agg(F.count_if("counted").alias("live_permits"), F.count_if("live").alias("live_locks")),
        f"""select semaphore, count(*) filter (expires_at > {ORDER_NOW}) as live_permits, count(*) filter (expires_at >= {ORDER_NOW}) as live_locks
            from permits group by semaphore"""),
    "validate_barriers": entry(
        lambda t: validate.validate_specs(loose_barriers(t), "barrier"),
        f"""with specs as (
              select o_orderkey as k, case when o_orderkey % 11 > 0 then o_orderkey % 6 end as expected,
                case when o_orderkey % 2 = 0 then o_orderkey % 9 end as quorum from orders)
            select {NS}, k::varchar as name, rule, message from (
              select k, 'expected_required' as rule, 'expected is required' as message from specs where expected is null
              union all select k, 'expected_min', 'expected must be at least 1' from specs where expected < 1
              union all select k, 'quorum_min', 'quorum must be at least 1' from specs where quorum < 1
              union all select k, 'quorum_max', 'quorum must not exceed expected' from specs where quorum > expected
              union all select k, 'timeout_duration', 'timeout is not a duration' from specs where k % 7 = 0
              union all select k, 'unknown_field', 'unknown field maxRetries' from specs where k % 10 = 0)"""),
    "validate_gates": entry(
        lambda t: validate.validate_specs(loose_gates(t), "gate"),
        f"""select {NS}, n_nationkey::varchar as name, case n_nationkey % 5 when 0 then 'conditions_min' when 1 then 'condition_type'
                when 2 then 'condition_name' else 'condition_state' end as rule,
              case n_nationkey % 5 when 0 then 'a gate needs at least one condition' when 1 then 'unknown condition type'
                when 2 then 'a condition needs a name' else 'unknown condition state' end as message
            from nation where n_nationkey % 5 < 4"""),
    "validate_status": entry(
        lambda t: validate.validate_specs(semaphore.semaphore_status(t.semaphores(), t.permits(), ORDER_AS_OF), "semaphore_status"),
        f"select {NS}, name, 'available_min' as rule, 'available must be at least 0' as message from semaphore_now where available < 0"),
    # ---- reports
    "status_all": entry(everything, f"select * from ({EVERYTHING})"),
    "kind_counts": entry(
        lambda t: report.kind_counts(known_resources(t)), f"select kind, count(*) as resources from ({EVERYTHING}) group by kind"),
    "phase_summary": entry(
        lambda t: report.phase_summary(everything(t)),
        f"select ns, kind, phase, count(*) as resources from ({EVERYTHING}) group by rollup (ns, kind, phase)"),
    "semaphore_detail": entry(
        lambda t: report.status_detail(
            "semaphore", semaphore.semaphore_status(t.semaphores(), t.permits(), ORDER_AS_OF),
            t.permits().filter(f"acquired_at <= {ORDER_NOW} and expires_at > {ORDER_NOW}").withColumnRenamed("semaphore", "name")),
        f"""select {NS}, name, 'resource' as part, phase || ' ' || in_use || '/' || permits as detail from semaphore_now
            union all select 'default', semaphore, 'permit', holder || ' ' || strftime(expires_at, '%H:%M:%S') from permits
              where acquired_at <= {ORDER_NOW} and expires_at > {ORDER_NOW}"""),
    "barrier_detail": entry(
        lambda t: report.status_detail(
            "barrier", barrier.barrier_status(t.barriers(), t.arrivals(), ORDER_AS_OF),
            barrier.barrier_arrivals(t.arrivals().filter(F.col("arrived_at") <= ORDER_AS_OF))),
        f"""select {NS}, name, 'resource' as part, phase || ' ' || arrived || '/' || required || coalesce(' ' || strftime(opened_at, '%Y-%m-%d %H:%M:%S'), '') as detail from barrier_now
            union all select 'default', barrier, 'arrival', holder from arrivals where arrived_at <= {ORDER_NOW} and barrier in (select name from barrier_now)"""),
    "lease_detail": entry(
        lambda t: report.status_detail("lease", lease.lease_status(P.held_leases(t), t.lease_requests(), ORDER_AS_OF), lease_children(t)),
        f"""select {NS}, name, 'resource' as part, case when holder is null then 'Available Available' else 'Held ' || holder end || ' ' ||
              coalesce(strftime(expires_at, '%H:%M:%S'), 'N/A') as detail from lease_now
            union all select 'default', lease, 'pending request', holder || ' ' || priority from lease_requests where phase is null and requested_at <= {ORDER_NOW}"""),
    "gate_detail": entry(
        gate_listing,
        f"""select {NS}, name, 'resource' as part, phase || ' ' || conditions_met || '/' || conditions_total as detail from gate_now
            union all select 'default', name, 'condition', type || '/' || condition || case when met then ' met ' else ' not met ' end || message from checked"""),
    "mutex_detail": entry(
        lambda t: report.status_detail("mutex", mutex.mutex_status(t.mutex_ops(), EVENT_AS_OF)),
        f"""select {NS}, name, 'resource' as part, case when alive then 'Locked ' || h || ' ' || strftime(la + interval 12 hour, '%H:%M:%S') else 'Unlocked N/A N/A' end as detail
            from (select name, s.h as h, s.la as la, coalesce(s.la + interval 12 hour >= {EVENT_NOW}, false) as alive
                  from (select name, arg_max({{'h': h, 'la': la}}, rn) as s from mutex_walk where ts <= {EVENT_NOW} group by name))"""),
    "rwmutex_detail": entry(
        lambda t: report.status_detail("rwmutex", rwmutex.rwmutex_status(t.rwmutex_ops(), EVENT_AS_OF)),
        f"""select {NS}, name, 'resource' as part, case when alive and w is not null then 'WriteLocked ' || w
              when alive and len(r) > 0 then 'ReadLocked ' || array_to_string(r, ',') else 'Unlocked N/A' end as detail
            from (select name, s.w as w, s.r as r, coalesce(s.ex >= {EVENT_NOW}, false) as alive
                  from (select name, arg_max({{'w': w, 'r': r, 'ex': ex}}, rn) as s from rw_walk where ts <= {EVENT_NOW} group by name))"""),
    "once_detail": entry(
        lambda t: report.status_detail("once", once.once_status(t.onces(), t.claims(), EVENT_AS_OF)),
        f"""select {NS}, o.name, 'resource' as part, case when w.name is null then 'Pending N/A N/A' else 'Executed ' || w.executor || ' ' || strftime(w.executed_at, '%H:%M:%S') end as detail
            from onces o left join (select name, arg_min(executor, ts) as executor, min(ts) as executed_at from claims where ok and ts <= {EVENT_NOW} group by name) w on w.name = o.name
            where o.created_at <= {EVENT_NOW} and {EVENT_NOW} <= o.created_at + interval 7 day"""),
    "waitgroup_detail": entry(
        lambda t: report.as_json(report.status_detail("waitgroup", waitgroup.waitgroup_status(t.waitgroups(), t.deltas(), EVENT_AS_OF))),
        f"""select {NS}, c_custkey::varchar as name, '{{"ns":"default","name":"' || c_custkey || '","part":"resource","detail":"' ||
              case when coalesce(k, 0) <= 0 then 'Done ' else 'Waiting ' end || coalesce(k, 0) || '"}}' as json
            from customer left join (select name, arg_max(counter, rn) as k from counter_walk where ts <= {EVENT_NOW} group by name) w on w.name = c_custkey::varchar"""),
    "expiring_soon": entry(
        lambda t: report.expiring_soon(deadlines(t), ORDER_AS_OF, 50),
        f"""select kind, {NS}, name, deadline, {secs(ORDER_NOW, 'deadline')} as remaining_seconds from (
              select distinct 'Permit' as kind, semaphore || '/' || holder as name, expires_at as deadline from permits where acquired_at <= {ORDER_NOW}
              union all select 'Barrier', name, deadline from opened where created_at <= {ORDER_NOW} and (opened_at is null or opened_at > {ORDER_NOW})
              union all select 'Gate', name, deadline from gates
              union all select 'Lease', name, expires_at from lease_now
              union all select 'Mutex', name, la + interval 12 hour
                from (select name, s.la as la from (select name, arg_max({{'la': la}}, rn) as s from mutex_walk where ts <= {EVENT_NOW} group by name))
                where la + interval 12 hour >= {EVENT_NOW}
              union all select 'RWMutex', name, ex
                from (select name, s.ex as ex from (select name, arg_max({{'ex': ex}}, rn) as s from rw_walk where ts <= {EVENT_NOW} group by name))
                where ex >= {EVENT_NOW})
            where deadline > {ORDER_NOW} order by deadline, kind, name limit 50"""),
    "transition_log": entry(
        lambda t: report.transition_log(transition_source(t)),
        """with logs as (
              select 'Gate' as kind, name, ts, seq, phase from phase_log
              union all select 'WaitGroup', name, ts, seq, case when counter > 0 then 'Waiting' else 'Done' end from counter_walk where rn > 0),
            changes as (
              select * from (select *, lag(phase) over (partition by kind, name order by ts, seq) as before from logs) where before is null or before <> phase)
            select kind, phase as from_phase, n.phase as to_phase, count(*) as transitions, floor(sum(epoch_us(n.ts) - epoch_us(ts)) / 1000000.0)::bigint as dwell_seconds
            from (select *, lead({'phase': phase, 'ts': ts}) over (partition by kind, name order by ts, seq) as n from changes)
            where n is not null group by kind, phase, n.phase"""),
}
