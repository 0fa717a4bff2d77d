"""Registered streaming queries: the whole table runs through the stream, the output is a table.

The SQL describes the same result as of the end of the stream, which is the moment the
watermark, the newest event time less the allowed lateness, has passed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from coordlytics.plans.bindings import Tables
from coordlytics.plans.catalog import Entry, with_tables
from coordlytics.plans.catalog_primitives import EVENT_NOW, EXTRA, NS
from coordlytics.plans.durable import fresh_path
from coordlytics.streaming import runtime, streams

NO_DELAY = "0 seconds"


def passed(at: str, log: str) -> str:
    """Whether the final watermark of ``log`` reached an instant, in whole milliseconds as timers have it."""
    return f"ceil(epoch_us({at}) / 1000.0) <= (select floor(max(epoch_us(ts)) / 1000.0) from {log})"


STREAMS = {
    **EXTRA,
    "once_seq": """
      select event_type as name, 'h' || (event_id % 3) as holder, ts, event_id as seq,
        row_number() over (partition by event_type order by ts, event_id) as rn from events""",
    "once_walk": """
      select name, 0::bigint as rn, null::varchar as holder, null::timestamp as ts, null::bigint as seq, null::timestamp as taken, false as hit
      from (select distinct name from once_seq)
      union all
      select o.name, o.rn, o.holder, o.ts, o.seq,
        case when w.taken + interval 6 hour >= o.ts then w.taken else o.ts end, not coalesce(w.taken + interval 6 hour >= o.ts, false)
      from once_walk w join once_seq o on o.name = w.name and o.rn = w.rn + 1""",
    "barrier_log": """
      select name, created_at as ts from barriers union all select l_orderkey::varchar, l_shipdate from lineitem""",
}


for _name in ("lease_requests_log", "lease_clears", "lease_walk"):
    # the same relations without an end of the log
    STREAMS[f"full_{_name}"] = (
        re.sub(r"\blease_(requests_log|clears|walk)\b", r"full_lease_\1", EXTRA[_name]).replace(f"and ts <= {EVENT_NOW}", ""))


def live(t: Tables) -> Tables:
    return t.as_streams()


def reported_outcomes(t: Tables) -> DataFrame:
    """Lock attempts with a reported result."""
    return t.events(kind="'mutex'", holder="concat('h', event_id % 3)", op="'lock'", ok="value >= 20").filter("ts is not null")


def once_events(t: Tables) -> DataFrame:
    return t.events(kind="'once'", name="event_type", holder="concat('h', event_id % 3)", ttl="make_dt_interval(0, 6)")


def latest_phase(t: Tables) -> DataFrame:
    """IO9: the newest phase per gate, written batch by batch."""
    path = fresh_path(t.spark, "latest-phase")
    log = live(t).events(op="if(value >= 20, 'Open', 'Waiting')").select("ns", "name", "ts", "seq", F.col("op").alias("phase"))
    runtime.upsert_status(log, path, f"{path}-checkpoint").awaitTermination()
    return runtime.read_status(t.spark, path)


def counted_once(t: Tables) -> DataFrame:
    """Counts per event type, each batch counted once."""
    path = fresh_path(t.spark, "counted")

    def count(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("holder").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    log = live(t).events(holder="event_type")
    runtime.run_once_per_batch(log, "count", f"{path}-ledger", f"{path}-checkpoint", count).awaitTermination()
    return t.spark.read.parquet(path).groupBy("holder").agg(F.sum("n").alias("events"))


def semaphore_changes(t: Tables) -> DataFrame:
    """Availability of the semaphores after each permit event, as reported status rows."""
    return live(t).events(
        kind="'Semaphore'", name="event_id % 20", op="'status'", delta="cast(value as int) % 6").select(
        "kind", "ns", "name", "ts", "seq", F.lit(None).cast("string").alias("phase"),
        F.col("delta").cast("long").alias("available"), F.lit(None).cast("long").alias("succeeded"))


def watching_gates(t: Tables) -> DataFrame:
    """One gate per customer that needs two free permits on each of two semaphores."""
    need = "named_struct('type', 'Semaphore', 'name', cast({0} % 25 as string), 'namespace', '', 'state', '', 'value', 2)"
    return t.raw("customer").selectExpr(
        "'default' as ns", "cast(c_custkey as string) as name", "timestamp '2024-01-01 00:00:00' as created_at",
        "make_dt_interval(10) as timeout", f"array({need.format('c_custkey')}, {need.format('(c_custkey + 7)')}) as conditions")


def touched_gates(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "gates")
    streams.gate_stream(semaphore_changes(t), watching_gates(t), "ts", path, f"{path}-checkpoint").awaitTermination()
    return runtime.latest_rows(t.spark.read.parquet(f"{path}/gates"), ["ns", "name"], ["ts"]).select(
        "ns", "name", "conditions_met", "conditions_total", "phase")


def entry(run, body: str) -> Entry:
    return Entry(run, with_tables(body, STREAMS))


def drained(build, label: str):
    return lambda t: runtime.drain(build(live(t)), label)


ENTRIES: dict[str, Entry] = {
    "barrier_stream": entry(
        drained(lambda t: streams.barrier_stream(t.barrier_log(), NO_DELAY), "barrier"),
        f"""select {NS}, name, 'Open' as phase, opened_at as ts, (select count(*) from arrivals a where a.barrier = name and a.arrived_at <= opened_at and (opened_at = created_at or a.arrived_at < opened_at or a.seq <= last_seq)) as arrived
            from (select o.*, a.seq as last_seq from opened o left join ranked_arrivals a on a.barrier = o.name and a.pos = o.required) where opened_at is not null
            union all
            select 'default', name, 'Failed', deadline, (select count(*) from arrivals a where a.barrier = name and a.arrived_at <= deadline)
            from opened where opened_at is null and {passed('deadline', 'barrier_log')}"""),
    "mutex_stream": entry(
        drained(lambda t: streams.mutex_stream(t.mutex_ops(), NO_DELAY), "mutex"),
        f"""select {NS}, name, seq, ts, op, holder, ok, outcome, blocked_by, locked_at, locked_at + interval 12 hour as expires_at from mutex_replay
            union all
            select 'default', a.name, null, a.ts + interval 12 hour, 'expire', a.holder, true, 'expired', null, a.ts, a.ts + interval 12 hour
            from mutex_replay a where a.outcome = 'acquired'
              and not exists (select 1 from mutex_replay r where r.name = a.name and r.outcome = 'released' and r.locked_at = a.ts)
              and {passed("a.ts + interval 12 hour", 'mutex_ops')}"""),
    "rwmutex_stream": entry(
        drained(lambda t: streams.rwmutex_stream(t.rwmutex_ops(), NO_DELAY), "rwmutex"),
        f"""select {NS}, name, seq, ts, op, who as holder, outcome in ('read_locked', 'write_locked', 'read_released', 'write_released') as ok, outcome,
              len(r) as readers, w as writer, ex as expires_at from rw_walk where rn > 0
            union all
            select 'default', name, null, expired_at, 'expire', w0, true, 'expired', 0, null, null
            from (select *, lag(w) over (partition by name order by rn) as w0 from rw_walk) where expired_at is not null
            union all
            select 'default', name, null, s.ex, 'expire', s.w, true, 'expired', 0, null, null
            from (select name, arg_max({{'ex': ex, 'w': w}}, rn) as s from rw_walk group by name) where {passed('s.ex', 'rwmutex_ops')}"""),
    "lease_stream": entry(
        drained(lambda t: streams.lease_stream(t.lease_log(), NO_DELAY), "lease"),
        f"""select {NS}, w.name, r.holder, r.priority::bigint as priority, w.seq, w.started_at,
              coalesce(w.cleared_at, w.started_at + interval 6 hour) as ended_at, case when w.cleared_at is not null then 'clear' else 'ttl' end as end_reason
            from full_lease_walk w join lease_log r on r.seq = w.seq
            where w.step > 0 and (w.cleared_at is not null or {passed("w.started_at + interval 6 hour", 'lease_log')})
              and w.started_at <= (select max(ts) from lease_log)"""),
    "semaphore_stream": entry(
        drained(lambda t: streams.semaphore_stream(t.permit_events(), NO_DELAY), "semaphore"),
        f"""select {NS}, name, ts, in_use from (
              select *, sum(d) over (partition by name order by ts)::bigint as in_use from (
                select name, ts, sum(d) as d from (
                  select name, acquired_at as ts, 1 as d from permit_pairs union all select name, ended_at, -1 from permit_pairs) group by name, ts))
            where d <> 0"""),
    "waitgroup_stream": entry(
        drained(lambda t: streams.waitgroup_stream(t.deltas(), NO_DELAY), "waitgroup"),
        f"""select {NS}, name, ts, seq, delta, counter, lost, case when counter > 0 then 'Waiting' else 'Done' end as phase from counter_walk where rn > 0"""),
    "once_stream": entry(
        drained(lambda t: streams.once_stream(once_events(t), NO_DELAY), "once"),
        f"select {NS}, name, holder, ts, seq from once_walk where hit"),
    "dedupe_creates_stream": entry(
        drained(lambda t: streams.dedupe_creates_stream(t.events(kind="event_type"), "40 days").select("ns", "kind", "name"), "creates"),
        f"select distinct {NS}, event_type as kind, user_id::varchar as name from events"),
    "contention_stream": entry(
        drained(lambda t: streams.contention_stream(reported_outcomes(t), "10 minutes", delay=NO_DELAY), "contention"),
        f"""select {NS}, user_id::varchar as name, w as window_start, w + interval 10 minute as window_end, count(*) as attempts,
              count(*) filter (value < 20) as rejections, count(distinct event_id % 3) as contenders
            from (select *, time_bucket(interval 10 minute, ts) as w from events)
            group by user_id, w having {passed("w + interval 10 minute", 'events')}"""),
    "contention_sliding_stream": entry(
        drained(lambda t: streams.contention_stream(reported_outcomes(t), "1 hour", "30 minutes", delay=NO_DELAY), "contention"),
        f"""select {NS}, user_id::varchar as name, w as window_start, w + interval 1 hour as window_end, count(*) as attempts,
              count(*) filter (value < 20) as rejections, count(distinct event_id % 3) as contenders
            from (select *, unnest([time_bucket(interval 30 minute, ts), time_bucket(interval 30 minute, ts) - interval 30 minute]) as w from events)
            group by user_id, w having {passed("w + interval 1 hour", 'events')}"""),
    "heartbeat_stream": entry(
        drained(lambda t: streams.heartbeat_stream(t.heartbeats(), NO_DELAY), "heartbeat"),
        f"""select {NS}, name, holder, min(ts) as started_at, max(ts) + interval 6 hour as ended_at, count(*) - 1 as renew_count
            from (select *, sum(case when before + interval 6 hour >= ts then 0 else 1 end) over (partition by name, holder order by ts, seq) as reign
                  from (select *, lag(ts) over (partition by name, holder order by ts, seq) as before from heartbeats))
            group by name, holder, reign having {passed("max(ts) + interval 6 hour", 'heartbeats')}"""),
    "late_arrivals": entry(
        lambda t: runtime.drain(streams.late_arrivals(live(t).arrivals(), t.barriers()).select("ns", "barrier", "holder", "arrived_at", "deadline", "late"), "late"),
        f"""select {NS}, b.name as barrier, l_linenumber::varchar as holder, l_shipdate as arrived_at, b.deadline, coalesce(l_shipdate > b.deadline, false) as late
            from lineitem join barriers b on b.name = l_orderkey::varchar"""),
    "upsert_status": entry(
        latest_phase,
        f"""select {NS}, user_id::varchar as name, max(ts) as ts, arg_max(event_id, ts) as seq,
              arg_max(case when value >= 20 then 'Open' else 'Waiting' end, ts) as phase from events group by user_id"""),
    "run_once_per_batch": entry(counted_once, "select event_type as holder, count(*) as events from events group by event_type"),
    "gate_stream": entry(
        touched_gates,
        f"""with latest as (
              select (event_id % 20)::varchar as name, arg_max(value::int % 6, ts) as available from
                (select event_id, ts, trunc(value) as value from events) group by all),
            needs as (
              select c_custkey::varchar as gate, unnest([(c_custkey % 25)::varchar, ((c_custkey + 7) % 25)::varchar]) as name from customer),
            counted as (
              select n.gate, count(*) as total, count(*) filter (l.available >= 2) as met, count(l.name) as known
              from needs n left join latest l on l.name = n.name group by n.gate)
            select {NS}, gate as name, met as conditions_met, total as conditions_total,
              case when met = total then 'Open' when timestamp '2024-01-11' < (select max(ts) from events) then 'Failed' else 'Waiting' end as phase
            from counted where known > 0"""),
    "gate_phase_stream": entry(
        # the gates are a batch table: only the changes are a stream
        lambda t: runtime.drain(streams.gate_phase_stream(semaphore_changes(t), watching_gates(t), NO_DELAY), "gate-phases"),
        f"""with needs as (
              select c_custkey::varchar as gate, unnest([(c_custkey % 25)::varchar, ((c_custkey + 7) % 25)::varchar]) as name, unnest([0, 1]) as pos
              from customer),
            seen as (
              select n.gate, n.pos, e.ts, e.event_id, trunc(e.value)::int % 6 >= 2 as met
              from needs n join events e on (e.event_id % 20)::varchar = n.name),
            flips as (
              select gate, ts, met::int - coalesce(lag(met) over (partition by gate, pos order by ts, event_id), false)::int as d from seen),
            steps as (
              select gate, ts, 0 as late, sum(d) as d from flips group by gate, ts
              union all select distinct gate, timestamp '2024-01-11', 1, 0 from needs),
            levels as (
              select gate, ts, late, sum(d) over w as met from steps window w as (partition by gate order by ts, late)),
            phases as (
              select *, case when met = 2 then 'Open' when late = 1 or ts > timestamp '2024-01-11' then 'Failed' else 'Waiting' end as phase from levels),
            edges as (select *, coalesce(lag(phase) over (partition by gate order by ts, late), 'Waiting') as before from phases)
            select {NS}, gate as name, phase, ts, met::bigint as conditions_met, 2::bigint as conditions_total from edges
            where phase <> before and ts >= timestamp '2024-01-01'"""),
}
