"""The reference cases and the boundaries between them, as small tables."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from coordlytics.functions import columns as C
from coordlytics.operators import barrier, gate, lease, mutex, once, relations, report, rwmutex, semaphore, validate, waits, waitgroup
from helpers import *

NOW = stamp(T0)
HOUR = timedelta(hours=1)


# ---- barriers


@pytest.mark.parametrize("expected, quorum, holders, phase", [
    (3, None, [], "Waiting"), (3, None, ["holder-1"], "Waiting"), (2, None, ["holder-1", "holder-2"], "Open"),
    (5, 2, ["holder-1", "holder-2"], "Open"), (2, None, ["holder-1", "holder-1"], "Waiting")])
def test_barrier(spark, expected, quorum, holders, phase):
    b = frame(spark, BARRIERS, [("default", "b", at(hours=-1), expected, quorum, None)])
    a = frame(spark, ARRIVALS, [("default", "b", h, at(minutes=i - 30), i) for i, h in enumerate(holders)])
    row = barrier.barrier_status(b, a, NOW).first()
    assert (row.phase, row.arrived) == (phase, len(set(holders)))
    assert (row.opened_at is not None) == (phase == "Open")


def test_barrier_deadline(spark):
    b = frame(spark, BARRIERS, [
        ("default", "late", at(hours=-2), 1, None, HOUR), ("default", "on_time", at(hours=-2), 1, None, HOUR),
        ("default", "due_now", at(hours=-1), 1, None, HOUR), ("default", "past", at(hours=-2), 3, None, HOUR)])
    a = frame(spark, ARRIVALS, [
        ("default", "late", "h", at(hours=-1, microseconds=1), 1), ("default", "on_time", "h", at(hours=-1), 1)])
    assert got(barrier.barrier_status(b, a, NOW), "name", "phase", "arrived") == [
        ("due_now", "Waiting", 0), ("late", "Failed", 1), ("on_time", "Open", 1), ("past", "Failed", 0)]


def test_barrier_timeline_reopens_only_before_the_deadline(spark):
    b = frame(spark, BARRIERS, [("default", "b", at(), 2, None, timedelta(hours=5))])
    steps = [(1, 1), (2, 1), (3, -1), (4, 1), (6, -1), (7, 1)]
    e = frame(spark, "ns string, name string, ts timestamp, delta long", [("default", "b", at(hours=h), d) for h, d in steps])
    rows = sorted(barrier.barrier_phase_timeline(b, e).collect(), key=lambda r: r.started_at)
    assert [(r.phase, r.started_at) for r in rows] == [
        ("Waiting", at()), ("Open", at(hours=2)), ("Waiting", at(hours=3)), ("Open", at(hours=4)), ("Failed", at(hours=6))]
    assert rows[-1].ended_at is None and {r.opened_at for r in rows[1:]} == {at(hours=2)}


def test_barrier_missing_and_slack(spark):
    b = frame(spark, BARRIERS, [("default", "b", at(hours=-1), 3, 2, None)])
    a = frame(spark, ARRIVALS, [("default", "b", h, at(minutes=-5), i) for i, h in enumerate("xy")])
    roster = frame(spark, "ns string, barrier string, holder string", [("default", "b", h) for h in "xyz"])
    assert got(barrier.barrier_missing(roster, a), "holder") == [("z",)]
    assert got(barrier.quorum_slack(b, a, NOW), "outstanding", "tolerated", "opened_early") == [(1, 1, True)]


# ---- semaphores


@pytest.mark.parametrize("permits, expiries, want", [
    (5, [None], ("Ready", 1, 4)), (2, [None, None], ("Full", 2, 0)), (3, [-1, 1], ("Ready", 1, 2)),
    (1, [None, None], ("Full", 2, -1)), (1, [], ("Ready", 0, 1)), (1, [0], ("Ready", 0, 1))])
def test_semaphore(spark, permits, expiries, want):
    s = frame(spark, SEMAPHORES, [("default", "s", permits)])
    p = frame(spark, PERMITS, [
        ("default", "s", f"h{i}", at(hours=-2), None if e is None else at(hours=e), i, None) for i, e in enumerate(expiries)])
    assert got(semaphore.semaphore_status(s, p, NOW), "phase", "in_use", "available") == [want]
    assert semaphore.permit_status(p, NOW).filter("phase = 'Granted'").count() == want[1]


def test_admission_and_oversubscription(spark):
    s = frame(spark, SEMAPHORES, [("default", "s", 2)])
    p = frame(spark, PERMITS, [("default", "s", f"h{i}", at(minutes=i - 10), at(minutes=i + 10), i, None) for i in range(4)])
    assert got(semaphore.permit_admission(s, p, NOW), "position", "phase") == [(1, "Granted"), (2, "Granted"), (3, "Denied"), (4, "Denied")]
    line = semaphore.in_use_timeline(p.withColumnsRenamed({"semaphore": "name", "expires_at": "ended_at"}))
    over = semaphore.oversubscription(line, s).collect()
    assert [(r.started_at, r.ended_at, r.peak_excess) for r in over] == [(at(minutes=-8), at(minutes=11), 2)]


def test_release_ends_the_oldest_permit_and_needs_one(spark):
    ops = [("release", 0), ("acquire", 1), ("acquire", 2), ("release", 3), ("release", 4), ("release", 5), ("acquire", 6)]
    log = frame(spark, LOCK_OPS, [("default", "s", op, "h", at(minutes=m), m, None) for op, m in ops])
    rows = got(semaphore.permit_intervals(log), "acquired_at", "released_at", "end_reason")
    assert sorted(rows, key=lambda r: r[0]) == [
        (at(minutes=1), at(minutes=3), "release"), (at(minutes=2), at(minutes=4), "release"), (at(minutes=6), None, "open")]


# ---- leases


def test_lease(spark):
    leases = frame(spark, LEASES, [
        ("default", "idle", HOUR, None, None, None), ("default", "one", HOUR, "", None, None),
        ("default", "priority", HOUR, None, None, None), ("default", "expired", HOUR, "holder-1", at(hours=-2), at(hours=-1)),
        ("default", "due", HOUR, "holder-1", at(hours=-1), at()), ("default", "tie", None, None, None, None)])
    requests = frame(spark, REQUESTS, [
        ("default", "one", "holder-1", None, at(hours=-1), 1, None), ("default", "priority", "holder-1", 1, at(hours=-2), 2, None),
        ("default", "priority", "holder-2", 5, at(hours=-1), 3, None), ("default", "tie", "b", 1, at(hours=-1), 5, None),
        ("default", "tie", "a", 1, at(hours=-1), 4, "Granted")])
    assert got(lease.lease_status(leases, requests, NOW), "name", "phase", "holder", "expires_at") == [
        ("due", "Held", "holder-1", at()), ("expired", "Available", None, None), ("idle", "Available", None, None),
        ("one", "Held", "holder-1", at(hours=1)), ("priority", "Held", "holder-2", at(hours=1)), ("tie", "Held", "a", None)]
    assert got(lease.lease_arbitration(leases, requests, False), "name", "holder")[-1] == ("tie", "b")


def test_lease_tenures(spark):
    log = frame(spark, LOCK_OPS + ", priority int", [
        ("default", "l", "request", "a", at(minutes=0), 1, HOUR, 0), ("default", "l", "request", "b", at(minutes=10), 2, HOUR, 1),
        ("default", "l", "request", "c", at(minutes=20), 3, HOUR, 5), ("default", "l", "clear", None, at(minutes=90), 4, HOUR, None),
        ("default", "l", "request", "d", at(hours=8), 5, HOUR, None)])
    rows = sorted(lease.lease_tenures(log, stamp(at(hours=8, minutes=30))).collect(), key=lambda r: r.started_at)
    assert [(r.holder, r.started_at, r.ended_at, r.end_reason) for r in rows] == [
        ("a", at(), at(hours=1), "ttl"), ("c", at(hours=1), at(minutes=90), "clear"),
        ("b", at(minutes=90), at(minutes=150), "ttl"), ("d", at(hours=8), None, "open")]
    events = frame(spark, "ns string, name string, ts timestamp, seq long", [
        ("default", "l", at(hours=1), 1), ("default", "l", at(hours=3), 2), ("default", "l", at(hours=9), 3)])
    assert got(lease.leader_at(events, lease.lease_tenures(log, stamp(at(hours=8, minutes=30)))), "seq", "leader") == [(1, "c"), (2, None), (3, "d")]


def test_renewal_at_expiry_continues_the_reign(spark):
    beats = frame(spark, LOCK_OPS, [("default", "l", "renew", "h", at(hours=h, microseconds=u), i, HOUR) for i, (h, u) in enumerate([(0, 0), (1, 0), (2, 1)])])
    assert got(lease.heartbeat_sessions(beats), "started_at", "renew_count") == [(at(), 1), (at(hours=2, microseconds=1), 0)]


# ---- locks


def ops(spark, rows, ttl=None):
    return frame(spark, LOCK_OPS, [("default", "m", op, h, at(seconds=s), i, ttl) for i, (op, h, s) in enumerate(rows)])


def test_two_workers(spark):
    log = ops(spark, [("lock", "worker-1", 0), ("lock", "worker-2", 1), ("unlock", "worker-2", 2), ("unlock", "worker-1", 3), ("lock", "worker-2", 4), ("unlock", "", 5)])
    replay = mutex.mutex_replay(log)
    assert [r[1:] for r in got(replay, "seq", "outcome", "blocked_by")] == [
        ("acquired", None), ("locked", "worker-1"), ("not_holder", None), ("released", None), ("acquired", None), ("holder_required", None)]
    assert mutex.mutex_rejections(replay).count() == 3
    assert got(mutex.mutex_status(log, stamp(at(seconds=10))), "phase", "holder") == [("Locked", "worker-2")]


def test_lock_is_alive_at_its_expiry_and_gone_after(spark):
    ttl = timedelta(seconds=10)
    at_expiry = ops(spark, [("lock", "a", 0), ("lock", "b", 10)], ttl)
    assert got(mutex.mutex_replay(at_expiry), "seq", "outcome") == [(0, "acquired"), (1, "locked")]
    after = ops(spark, [("lock", "a", 0), ("unlock", "a", 12), ("lock", "b", 13)], ttl)
    assert got(mutex.mutex_replay(after), "seq", "outcome") == [(0, "acquired"), (1, "not_holder"), (2, "acquired")]
    assert got(mutex.mutex_status(ops(spark, [("lock", "a", 0)], ttl), stamp(at(seconds=10))), "phase") == [("Locked",)]
    assert got(mutex.mutex_status(ops(spark, [("lock", "a", 0)], ttl), stamp(at(seconds=12))), "phase") == [("Unlocked",)]


def test_rwmutex(spark):
    log = ops(spark, [
        ("rlock", "reader-1", 0), ("rlock", "reader-2", 1), ("lock", "w", 2), ("unlock", "reader-1", 3), ("rlock", "reader-2", 4),
        ("unlock", "reader-2", 5), ("lock", "w", 6), ("rlock", "reader-1", 7), ("unlock", "x", 8), ("unlock", "w", 9)])
    assert [r[1:] for r in got(rwmutex.rwmutex_replay(log), "seq", "outcome", "readers")] == [
        ("read_locked", 1), ("read_locked", 2), ("read_held", 2), ("read_released", 1), ("read_locked", 2), ("read_released", 0),
        ("write_locked", 0), ("write_held", 0), ("not_holder", 0), ("write_released", 0)]
    assert got(rwmutex.rwmutex_status(log, stamp(at(seconds=2))), "phase", "readers") == [("ReadLocked", "reader-1,reader-2")]
    assert got(rwmutex.writer_starvation(rwmutex.rwmutex_replay(log)), "holder", "refusals", "delay_seconds") == [("w", 1, 4)]
    expired = ops(spark, [("lock", "w", -3600)], timedelta(minutes=5))
    assert got(rwmutex.rwmutex_status(expired, NOW), "phase", "writer", "readers") == [("Unlocked", None, None)]


def test_readers_extend_the_shared_expiry(spark):
    log = ops(spark, [("rlock", "a", 0), ("rlock", "b", 8), ("lock", "w", 30)], timedelta(seconds=10))
    assert got(rwmutex.rw_ttl_extension(log), "ended_at", "end_reason", "read_locks", "extended_seconds") == [(at(seconds=18), "ttl", 2, 8)]


def test_overlaps(spark):
    spans = frame(spark, "ns string, name string, holder string, mode string, start_at timestamp, end_at timestamp, seq long", [
        ("default", "m", "a", "write", at(hours=0), at(hours=9), 1), ("default", "m", "a", "read", at(hours=1), at(hours=2), 2),
        ("default", "m", "b", "read", at(hours=9), at(hours=10), 3), ("default", "m", "c", "write", at(hours=9), at(hours=11), 4)])
    # b and c begin when a ends, so only c overlaps another holder, namely b
    assert got(mutex.exclusion_violations(spans), "holder", "held_by") == [("c", "b")]
    assert got(rwmutex.rw_conflicts(spans), "seq", "inside_write", "inside_read") == [(2, True, False), (4, False, True)]
    assert got(lease.overlapping_runs(spans), "seq") == [(2,), (4,)]


# ---- once and wait groups


def test_once(spark):
    claims = frame(spark, "ns string, name string, executor string, ts timestamp, seq long, ok boolean", [
        ("default", "job", "a", at(seconds=0), 1, False), ("default", "job", "b", at(seconds=1), 2, True),
        ("default", "job", "c", at(seconds=2), 3, True), ("default", "broken", "a", at(seconds=0), 4, False)])
    assert got(once.once_attempts(claims), "seq", "outcome") == [
        (1, "failed_rolled_back"), (2, "executed"), (3, "skipped_already_executed"), (4, "failed_rolled_back")]
    onces = frame(spark, "ns string, name string, created_at timestamp, ttl interval day to second", [
        ("default", "job", at(hours=-1), HOUR), ("default", "broken", at(hours=-1), None), ("default", "gone", at(hours=-1, microseconds=-1), HOUR)])
    assert got(once.once_status(onces, claims, NOW), "name", "phase") == [("broken", "Pending"), ("job", "Pending")]
    assert got(once.once_status(onces.filter("name <> 'gone'").withColumn("ttl", F.lit(None).cast("interval day to second")), claims, stamp(at(seconds=1))), "name", "phase", "executor") == [
        ("broken", "Pending", None), ("job", "Executed", "b")]
    assert got(once.once_pending(onces, claims), "name") == [("broken",), ("gone",)]


def test_waitgroup(spark):
    deltas = frame(spark, "ns string, name string, delta int, ts timestamp, seq long", [
        ("default", "w", d, at(seconds=i), i) for i, d in enumerate([-1, 5, 2, -7, -1, 1])])
    assert got(waitgroup.waitgroup_counter(deltas), "seq", "counter", "lost") == [(0, 0, 1), (1, 5, 0), (2, 7, 0), (3, 0, 0), (4, 0, 1), (5, 1, 0)]
    groups = frame(spark, "ns string, name string", [("default", "w"), ("default", "new")])
    assert got(waitgroup.waitgroup_status(groups, deltas, stamp(at(seconds=3))), "name", "counter", "phase") == [("new", 0, "Done"), ("w", 0, "Done")]
    assert got(waitgroup.waitgroup_status(groups, deltas, stamp(at(seconds=9))), "name", "phase") == [("new", "Done"), ("w", "Waiting")]
    assert got(waitgroup.waitgroup_episodes(deltas), "started_at", "done_at", "peak") == [
        (at(seconds=1), at(seconds=3), 7), (at(seconds=5), None, 1)]


# ---- gates


def conds(*rows):
    return [dict(zip(("type", "name", "namespace", "state", "value"), r)) for r in rows]


def test_gate(spark):
    gates = frame(spark, GATES, [
        ("default", "none", at(hours=-2), None, []), ("default", "none_late", at(hours=-2), HOUR, []),
        ("default", "job", at(hours=-2), HOUR, conds(("Job", "test-job", "", "Complete", None))),
        ("default", "sem", at(), None, conds(("Semaphore", "s", "", "", 3))),
        ("default", "held", at(), None, conds(("Lease", "held", "", "Available", None))),
        ("default", "free", at(), None, conds(("Lease", "free", "other", "Available", None))),
        ("default", "timeout", at(hours=-2), HOUR, conds(("Job", "missing", "", "Complete", None))),
        ("default", "due", at(hours=-1), HOUR, conds(("Job", "missing", "", "Complete", None))),
        ("default", "odd", at(), None, conds(("Mutex", "m", "", "Unlocked", None), ("Barrier", "b", "", "Closed", None), ("Semaphore", "s", "", "", None)))])
    resources = frame(spark, RESOURCES, [
        ("Job", "default", "test-job", None, None, 1), ("Semaphore", "default", "s", "Ready", 5, None), ("Lease", "default", "held", "Held", None, None),
        ("Lease", "other", "free", "Available", None, None), ("Barrier", "default", "b", "Open", None, None)])
    checked = gate.gate_conditions(gates, resources)
    assert got(gate.gate_status(gates, checked, NOW), "name", "phase", "conditions_met") == [
        ("due", "Waiting", 0), ("free", "Open", 1), ("held", "Waiting", 0), ("job", "Open", 1), ("none", "Open", 0), ("none_late", "Open", 0),
        ("odd", "Waiting", 0), ("sem", "Open", 1), ("timeout", "Failed", 0)]
    messages = dict(got(checked.filter("name in ('odd', 'timeout')"), "condition", "message"))
    assert messages == {"m": "Unknown condition type", "b": "Barrier is not open", "s": "Semaphore does not have required permits", "missing": "Job not found"}
    wanted = frame(spark, "ns string, name string, condition string", [("default", "sem", "s"), ("default", "job", "nowhere")])
    assert got(gate.gate_subset_ready(checked, wanted), "name", "ready") == [("job", False), ("sem", True)]


def test_last_of_equal_condition_names_counts(spark):
    c = frame(spark, "ns string, name string, pos int, condition string, met boolean", [("default", "g", 0, "x", True), ("default", "g", 1, "x", False)])
    assert got(gate.gate_subset_ready(c, c.select("ns", "name", "condition").distinct()), "ready") == [(False,)]


def test_closure_with_a_long_chain_and_a_cycle(spark):
    chain = [("default", f"g{i}", f"g{i + 1}") for i in range(40)]
    cycle = [("default", "a", "b"), ("default", "b", "c"), ("default", "c", "a"), ("default", "c", "g38")]
    edges = frame(spark, "ns string, name string, depends_on string", chain + cycle)
    closure = gate.gate_closure(edges)
    assert got(closure.filter("name = 'g0'").agg(F.count("*").alias("n"), F.max("depth").alias("d")), "n", "d") == [(40, 40)]
    assert got(closure.filter("name = 'a'"), "dependency", "depth") == [("a", 3), ("b", 1), ("c", 2), ("g38", 3), ("g39", 4), ("g40", 5)]
    summary = gate.closure_summary(closure, edges)
    assert got(summary.filter("in_cycle"), "name", "root_blockers") == [("a", 1), ("b", 1), ("c", 1)]


def test_gate_history(spark):
    gates = frame(spark, GATES, [("default", "g", at(), None, conds(("Barrier", "b", "", "Open", None), ("Semaphore", "s", "", None, 1)))])
    changes = frame(spark, "type string, target_ns string, condition string, ts timestamp, seq long, phase string, available long, succeeded long", [
        ("Barrier", "default", "b", at(hours=1), 0, "Open", None, None), ("Semaphore", "default", "s", at(hours=2), 0, None, 2, None),
        ("Semaphore", "default", "s", at(hours=3), 0, None, 1, None), ("Semaphore", "default", "s", at(hours=4), 0, None, 0, None)])
    assert [r[1:] for r in sorted(got(gate.gate_history(gates, changes), "started_at", "open", "ended_at"))] == [
        (False, at(hours=2)), (True, at(hours=4)), (False, None)]


# ---- waits, reports, rules


def test_waits(spark):
    moves = frame(spark, "ns string, name string, ts timestamp, phase string", [
        ("default", "open", at(), "Open"), ("default", "soon", at(seconds=30), "Open"), ("default", "late", at(seconds=31), "Open"), ("default", "bad", at(seconds=5), "Failed")])
    who = frame(spark, "ns string, name string, ts timestamp, seq long, timeout interval day to second", [
        ("default", n, at(), i, None) for i, n in enumerate(["open", "soon", "late", "bad", "never"])])
    assert got(waits.wait_outcomes(who, moves), "name", "outcome", "wait_seconds") == [
        ("bad", "failed", 5), ("late", "timeout", 30), ("never", "timeout", 30), ("open", "opened", 0), ("soon", "opened", 30)]


def test_update_conflicts(spark):
    rows = [("default", "k", 1, "u1", at(seconds=0), 1), ("default", "k", 1, "u2", at(seconds=0), 2), ("default", "k", 2, "u2", at(seconds=1), 3)]
    c = waits.update_conflicts(frame(spark, "ns string, name string, base_version long, update_id string, ts timestamp, seq long", rows))
    assert got(c, "seq", "outcome") == [(1, "applied"), (2, "conflict"), (3, "applied")]
    assert got(waits.update_retries(c), "update_id", "tries", "conflicts", "applied") == [("u1", 1, 0, True), ("u2", 2, 1, True)]


def test_status_of_mixed_kinds(spark):
    one = lambda **c: spark.range(1).selectExpr("'default' as ns", *[f"{v} as {k}" for k, v in c.items()])
    out = report.status_all(
        Semaphore=one(name="'s'", phase="'Ready'", used="2", total="5"), Barrier=one(name="'b'", phase="'Open'", used="5", total="5"),
        Lease=one(name="'l'", phase="'Available'", holder="cast(null as string)"), Gate=one(name="'g'", phase="'Open'", used="1", total="1"))
    assert got(out, "kind", "phase", "used", "total", "holder") == [
        ("Barrier", "Open", 5, 5, None), ("Gate", "Open", 1, 1, None), ("Lease", "Available", None, None, "Available"), ("Semaphore", "Ready", 2, 5, None)]
    assert report.phase_summary(out).count() == 4 + 4 + 1 + 1


@pytest.mark.parametrize("text, micros", [
    ("1h30m", 5_400_000_000), ("500ms", 500_000), ("1.5h", 5_400_000_000), ("10us", 10), ("2µs", 2), ("1500ns", 1), ("0s", 0),
    ("5x", None), ("5m 3s", None), ("", None), ("-5s", None), ("87600h", 315_360_000_000_000), (None, None)])
def test_durations(spark, text, micros):
    df = C.parse_durations(spark.createDataFrame([(text,)], "ttl string"), "ttl")
    row = df.select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.col("ttl_interval")).alias("m"), "ttl_valid").first()
    assert row.m == micros and row.ttl_valid == (text is None or micros is not None)


def test_expiry_boundaries(spark):
    df = spark.createDataFrame([("eq", at()), ("before", at(microseconds=-1)), ("none", None)], "name string, expires_at timestamp")
    assert got(C.is_live(df, NOW, permits=True), "name", "live") == [("before", False), ("eq", False), ("none", True)]
    assert got(C.is_live(df, NOW, permits=False), "name", "live") == [("before", False), ("eq", True), ("none", True)]


def test_labels(spark):
    df = spark.createDataFrame([("default", "a", {"barrier": "b"}), ("default", "c", {"barrier": "x"}), ("other", "a", {"barrier": "b"})], "ns string, barrier string, labels map<string,string>")
    assert relations.list_kind(df, "default", {"barrier": "b"}).count() == 1
    assert got(relations.label_spec_mismatch(df, "barrier"), "barrier") == [("a",), ("a",), ("c",)]


def test_rules_of_child_and_status_rows(spark):
    arrivals = spark.createDataFrame([("default", "a", "b", "x" * 253), ("default", "c", None, "x" * 254), ("default", "d", "y" * 64, "")], "ns string, name string, barrier string, holder string")
    assert got(validate.validate_specs(arrivals, "arrival"), "name", "rule") == [
        ("c", "barrier_required"), ("c", "holder_length"), ("d", "barrier_length"), ("d", "holder_length")]
    requests = spark.createDataFrame([("default", "r", "l", "h", -1, "5x")], "ns string, name string, lease string, holder string, priority int, ttl string")
    assert got(validate.validate_specs(requests, "lease_request"), "rule") == [("priority_min",), ("ttl_duration",)]
    semaphores = spark.createDataFrame([("default", "s", 0), ("default", "t", None), ("default", "u", 1)], "ns string, name string, permits int")
    assert got(validate.validate_specs(semaphores, "semaphore"), "name", "rule") == [("s", "permits_min"), ("t", "permits_required")]
    counted = spark.createDataFrame([("default", "w", -1)], "ns string, name string, counter long")
    assert got(validate.validate_specs(counted, "waitgroup_status"), "rule") == [("counter_min",)]
