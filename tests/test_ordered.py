"""Ordered computation against plain Python, on logs dominated by one key."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from coordlytics.functions.columns import parse_durations
from coordlytics.operators.lease import lease_tenures, overlapping_runs
from coordlytics.operators.mutex import (
    STRETCH, MutexFold, exclusion_violations, mutex_replay, mutex_status, mutex_tenures, stretched)
from coordlytics.operators.once import once_attempts
from coordlytics.operators.rwmutex import rw_conflicts, rwmutex_replay
from coordlytics.operators.semaphore import in_use_timeline, permit_intervals
from coordlytics.operators.validate import validate_specs
from coordlytics.operators.waitgroup import waitgroup_counter
from coordlytics.operators.waits import wait_outcomes
from coordlytics.plans import ordered
from coordlytics.plans.ordered import Prefix, ordered_scan, running_balance
from helpers import at, got


def skewed(n=900, seed=7):
    """Nine in ten rows belong to one key; values have nulls, times have ties."""
    rnd = random.Random(seed)
    return [
        ("k" if rnd.random() < 0.9 else f"c{rnd.randrange(5)}", rnd.randrange(200), i,
         None if rnd.random() < 0.2 else rnd.randrange(-5, 6))
        for i in range(n)
    ]


SPECS = {
    "total": lambda: Prefix("sum", F.col("v")),
    "total_before": lambda: Prefix("sum", F.col("v"), inclusive=False),
    "low": lambda: Prefix("min", F.col("v")),
    "high_after": lambda: Prefix("max", F.col("v"), inclusive=False, reverse=True),
    "last_known": lambda: Prefix("last", F.col("v")),
    "next_known": lambda: Prefix("last", F.col("v"), inclusive=False, reverse=True),
    "before": lambda: Prefix("prev", F.col("v")),
    "after": lambda: Prefix("prev", F.col("v"), reverse=True),
}


def brute(rows):
    out = []
    for key in {r[0] for r in rows}:
        log = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        values = [r[3] for r in log]
        known = lambda vs: [v for v in vs if v is not None]
        for i, r in enumerate(log):
            upto, before, after = known(values[: i + 1]), known(values[:i]), known(values[i + 1:])
            out.append((
                r[0], r[2], sum(upto) if upto else None, sum(before) if before else None, min(upto, default=None),
                max(after, default=None), upto[-1] if upto else None, after[0] if after else None,
                values[i - 1] if i else None, values[i + 1] if i + 1 < len(values) else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("span", [3, 1_000_000])
def test_scan_equals_brute_force(spark, monkeypatch, span):
    monkeypatch.setattr(ordered, "BUCKET_SPAN", span)
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, ts int, seq int, v int")
    out = ordered_scan(df, ["k"], ["ts", "seq"], {c: s() for c, s in SPECS.items()})
    assert got(out, "k", "seq", *SPECS) == brute(rows)


@pytest.mark.parametrize("span", [3, 1_000_000])
def test_balance_equals_brute_force(spark, monkeypatch, span):
    monkeypatch.setattr(ordered, "BUCKET_SPAN", span)
    rows = [(k, ts, seq, v or 1) for k, ts, seq, v in skewed(seed=3)]
    df = spark.createDataFrame(rows, "k string, ts int, seq int, v int")
    out = running_balance(df, ["k"], ["ts", "seq"], F.col("v"))
    want = []
    for key in {r[0] for r in rows}:
        total, floor = 0, None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
            total += r[3]
            floor = total if floor is None else min(floor, total)
            want.append((key, r[2], total, floor))
    assert got(out, "k", "seq", "total", "floor") == sorted(want, key=repr)


def test_one_key_is_spread_over_tasks(spark):
    df = spark.createDataFrame([("k", i * 100) for i in range(4000)], "k string, ts int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in ordered.bucketed(df, ["k"], ["ts"]).groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 6 and max(sizes) < 1500


def test_building_runs_no_job(spark):
    df = hot_lock_log(spark, ["lock", "unlock"])
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup())
    mutex_tenures(df)
    waitgroup_counter(df.withColumn("delta", F.lit(1)))
    rwmutex_replay(df)
    assert set(spark.sparkContext.statusTracker().getJobIdsForGroup()) == before


def hot_lock_log(spark, ops, n=1500, gap=40, ttl=90, seed=11):
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rnd.randrange(gap)
        name = "hot" if rnd.random() < 0.9 else f"m{rnd.randrange(4)}"
        rows.append(("default", name, rnd.choice(ops), f"h{rnd.randrange(4)}", at(seconds=t), i))
    df = spark.createDataFrame(rows, "ns string, name string, op string, holder string, ts timestamp, seq long")
    return df.withColumn("ttl", F.expr(f"make_dt_interval(0, 0, 0, {ttl})"))


def both(spark, build):
    """The same rows with a bucket for every minute as with one for the whole log."""
    frames = []
    for unit in ("minute", "year"):
        kept, ordered.BUCKET_UNIT = ordered.BUCKET_UNIT, unit
        frames.append(build())
        ordered.BUCKET_UNIT = kept
    a, b = (got(df, *df.columns) for df in frames)
    assert a and a == b
    return a


def test_silences_cut_a_log(spark):
    log = hot_lock_log(spark, ["lock", "unlock"], gap=200)
    stretches = stretched(log, ["lock"]).filter("name = 'hot'")
    assert stretches.select(STRETCH).distinct().count() > 50
    assert stretches.filter("end_us is null").select(STRETCH).distinct().count() == 1


def test_mutex_fold_on_a_hot_key(spark):
    log = hot_lock_log(spark, ["lock", "lock", "unlock"])
    rows = both(spark, lambda: mutex_replay(log))
    assert {r[7] for r in rows} == {"acquired", "locked", "released", "not_holder"}
    # a plain loop over the hot key
    state, want = None, []
    for r in sorted(log.filter("name = 'hot'").collect(), key=lambda r: (r.ts, r.seq)):
        if state and (r.ts - state[1]).total_seconds() > 90:
            state = None
        if r.op == "lock":
            want.append((r.seq, "acquired" if state is None else "locked"))
            state = state or (r.holder, r.ts)
        else:
            mine = state is not None and state[0] == r.holder
            want.append((r.seq, "released" if mine else "not_holder"))
            state = None if mine else state
    assert sorted(want) == sorted((r[2], r[7]) for r in rows if r[1] == "hot")


def test_mutex_without_ttl_on_a_hot_key(spark):
    log = hot_lock_log(spark, ["lock", "unlock"]).withColumn("ttl", F.lit(None).cast("interval day to second"))
    both(spark, lambda: mutex_replay(log))
    both(spark, lambda: mutex_status(log, "2024-03-01 00:00:00"))


def test_tenures_do_not_overlap(spark):
    log = hot_lock_log(spark, ["lock", "unlock"])
    both(spark, lambda: mutex_tenures(log, "2024-01-02 00:00:00"))
    tenures = sorted(mutex_tenures(log, "2024-01-02 00:00:00").collect(), key=lambda r: (r.name, r.locked_at))
    for a, b in zip(tenures, tenures[1:]):
        assert a.name != b.name or a.ended_at <= b.locked_at


def test_rwmutex_fold_on_a_hot_key(spark):
    log = hot_lock_log(spark, ["rlock", "rlock", "lock", "unlock", "unlock", "unlock"])
    rows = both(spark, lambda: rwmutex_replay(log))
    assert {"read_locked", "write_locked", "read_held", "write_held", "read_released", "write_released", "not_holder"} == {r[7] for r in rows}


def test_lease_fold_on_a_hot_key(spark):
    log = hot_lock_log(spark, ["request", "request", "request", "clear"]).withColumn("priority", (F.col("seq") % 5).cast("int"))
    rows = both(spark, lambda: lease_tenures(log, "2024-01-02 00:00:00"))
    assert {v for r in rows for v in r} >= {"ttl", "clear"}


def test_permits_on_a_hot_holder(spark):
    log = hot_lock_log(spark, ["acquire", "release"]).withColumn("holder", F.lit("one"))
    rows = both(spark, lambda: permit_intervals(log))
    assert rows
    spans = permit_intervals(log)
    steps = both(spark, lambda: in_use_timeline(spans))
    assert min(r[-1] for r in steps) >= 0


def test_counter_on_a_hot_key(spark):
    log = hot_lock_log(spark, ["x"]).withColumn("delta", (F.col("seq") % 7 - 3).cast("int"))
    rows = both(spark, lambda: waitgroup_counter(log))
    assert min(r[-2] for r in rows) == 0 and max(r[-1] for r in rows) > 0


def test_overloaded_lease(spark):
    # requests every second, one grant a minute: most requests can never be served
    log = hot_lock_log(spark, ["request"], gap=2, ttl=60).withColumn("priority", (F.col("seq") % 3).cast("int"))
    rows = both(spark, lambda: lease_tenures(log, "2024-01-01 13:00:00"))
    # an hour holds sixty grants of a minute, and one more that is still open
    assert 55 <= sum(1 for r in rows if r[1] == "hot") <= 61


def test_every_row_is_folded_once(spark):
    rows = [("default", "m", "lock", f"h{i % 5}", at(seconds=i), i) for i in range(2000)]
    log = spark.createDataFrame(rows, "ns string, name string, op string, holder string, ts timestamp, seq long")
    steps = spark.sparkContext.accumulator(0)

    class Counting(MutexFold):
        def step(self, state, row, emit):
            steps.add(1)
            return super().step(state, row, emit)

    endless = stretched(log.withColumn("ttl", F.lit(None).cast("interval day to second")), ["lock"])
    out = ordered.ordered_fold(endless, ["ns", "name", STRETCH], ["ts", "seq"], Counting("outcomes")).collect()
    assert len(out) == 2000 and steps.value == 2000
    assert {r.blocked_by for r in out} == {None, "h0"}


# ---- inputs that once gave wrong answers


def test_a_short_ttl_costs_no_tenure(spark):
    log = hot_lock_log(spark, ["request"], n=20, gap=2).withColumn(
        "ttl", F.expr("if(seq = 7, make_dt_interval(0), make_dt_interval(0, 1))")).withColumn("priority", F.lit(0))
    names = {r.name: r["count"] for r in log.groupBy("name").count().collect()}
    rows = lease_tenures(log, "2024-01-05 00:00:00").groupBy("name").count().collect()
    endless = {r.name for r in log.filter("seq = 7").collect()}
    for r in rows:
        assert r["count"] == names[r.name] or r.name in endless


def test_a_clear_has_no_ttl_to_give(spark):
    hour = "make_dt_interval(0, 1)"
    rows = [("default", "l", "request", "a", at(), 1), ("default", "l", "request", "b", at(seconds=1), 2),
            ("default", "l", "request", "c", at(seconds=2), 3), ("default", "l", "clear", None, at(minutes=5), 4)]
    log = spark.createDataFrame(rows, "ns string, name string, op string, holder string, ts timestamp, seq long").withColumn(
        "ttl", F.expr(f"if(op = 'request', {hour}, null)")).withColumn("priority", F.lit(0))
    got_ = [(r.holder, r.started_at, r.end_reason) for r in lease_tenures(log, "2024-01-02 00:00:00").orderBy("started_at").collect()]
    assert got_ == [("a", at(), "clear"), ("b", at(minutes=5), "ttl"), ("c", at(minutes=65), "ttl")]


def test_holds_without_an_end_go_on(spark):
    schema = "ns string, name string, holder string, mode string, start_at timestamp, end_at timestamp, seq long"
    rows = [("default", "x", "a", "write", at(seconds=1), None, 1), ("default", "x", "b", "write", at(seconds=5), at(seconds=9), 2)]
    df = spark.createDataFrame(rows, schema)
    assert [(r.holder, r.held_by, r.overlap_seconds) for r in exclusion_violations(df).collect()] == [("b", "a", 4)]
    assert [(r.holder, r.writer) for r in rw_conflicts(df).collect()] == [("b", "a")]
    assert [(r.holder, r.busy_until) for r in overlapping_runs(df).collect()] == [("b", None)]


def test_equal_seq_at_another_time_is_another_claim(spark):
    df = spark.createDataFrame(
        [("default", "k", "a", at(seconds=1), 1, True), ("default", "k", "b", at(seconds=2), 1, True)],
        "ns string, name string, executor string, ts timestamp, seq long, ok boolean")
    assert got(once_attempts(df), "executor", "outcome") == [("a", "executed"), ("b", "skipped_already_executed")]


def test_transitions_of_one_instant_keep_their_order(spark):
    waiters = spark.createDataFrame([("default", "b", at(seconds=9), 1)], "ns string, name string, ts timestamp, seq long").withColumn(
        "timeout", F.expr("make_dt_interval(0, 0, 1)"))
    for first, want in (("Waiting", "opened"), ("Open", "timeout")):
        second = {"Waiting": "Open", "Open": "Waiting"}[first]
        rows = [("default", "b", at(seconds=5), 2, second), ("default", "b", at(seconds=5), 1, first)]
        moves = spark.createDataFrame(rows, "ns string, name string, ts timestamp, seq long, phase string")
        assert got(wait_outcomes(waiters, moves), "outcome") == [(want,)]


def test_durations_beyond_eleven_digits(spark):
    texts = ["500000000000ns", "200000000000us", "9" * 30 + "h", "1.5h30m", "0.0000015s", "1h" * 40, "x", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, ttl string")
    out = parse_durations(df, "ttl").select(
        "i", "ttl_valid", F.unix_micros(F.timestamp_micros(F.lit(0)) + F.col("ttl_interval")).alias("us")).orderBy("i").collect()
    assert [(r.ttl_valid, r.us) for r in out] == [
        (True, 500_000_000), (True, 200_000_000_000), (False, None), (True, 7_200_000_000), (True, 1), (True, 144_000_000_000),
        (False, None), (True, None)]


def test_child_tables_are_validated_as_stored(spark):
    for kind, parent in (("arrival", "barrier"), ("permit", "semaphore"), ("lease_request", "lease")):
        df = spark.createDataFrame([("default", "p", None)], f"ns string, {parent} string, holder string")
        assert got(validate_specs(df, kind), "name") != []


# --- locks by composition ------------------------------------------------------------------------

def random_ops(rnd, n, gap=40):
    t, rows = 0, []
    for i in range(n):
        t += rnd.choice([0, 1, rnd.randrange(gap)])
        ttl = rnd.choice([None, None, 0, 5, 60, 400])
        rows.append((rnd.choice(["lock", "lock", "unlock"]), rnd.choice(["a", "b", "c", "", None]), t, ttl, i))
    return rows


def test_a_summary_does_what_the_operations_do():
    """Every prefix of random logs, entered in many states, against the operations one by one."""
    from coordlytics.operators.mutex import MutexFold

    rnd, fold = random.Random(3), MutexFold("outcomes")
    for _ in range(300):
        rows = random_ops(rnd, rnd.randint(1, 14))
        states = [None] + [(h, -9, e) for h in ("a", "b", "d", None) for e in (None, *range(-2, 120, 7))]
        effect = fold.summary(rows)
        for state in states:
            want = state
            for row in rows:
                want = fold.step(want, row, [].append)
            got = fold.through(effect, state)
            # a hold that has run out by the last operation is gone; one that runs out later is kept
            assert got == want, (rows, state)


def test_mutex_of_one_key_spreads_over_tasks(spark):
    """No ttl, one lock: many tasks replay it, with the outcomes of one loop."""
    from coordlytics.operators.mutex import MutexFold, mutex_replay, mutex_status, mutex_tenures

    rnd = random.Random(4)
    start, ops = datetime(2024, 1, 1), []
    for i in range(6000):
        ops.append(("default", "one", rnd.choice(["lock", "unlock"]), f"h{rnd.randrange(3)}", start + timedelta(minutes=7 * (i // 2)), i))
    df = spark.createDataFrame(ops, "ns string, name string, op string, holder string, ts timestamp, seq long").withColumn(
        "ttl", F.lit(None).cast("interval day to second"))
    fold, state, want = MutexFold("outcomes"), None, []
    for _, _, op, holder, ts, seq in ops:
        state = fold.step(state, (op, holder, int(ts.replace(tzinfo=timezone.utc).timestamp() * 1e6), None, seq), want.append)
    replay = mutex_replay(df)
    assert sorted((r["seq"], r["outcome"], r["blocked_by"]) for r in replay.collect()) == sorted((w[0], w[5], w[6]) for w in want)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins small partitions
    try:
        tasks = mutex_replay(df).select(F.spark_partition_id().alias("p"), "seq").groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) >= 6 and max(r["count"] for r in tasks) < 3000
    status = mutex_status(df, "2030-01-01 00:00:00").collect()
    assert [(r["holder"], r["phase"]) for r in status] == [(state[0] if state else None, "Locked" if state else "Unlocked")]
    ended = mutex_tenures(df).filter("ended_at is not null").count()
    assert ended == sum(w[5] == "released" for w in want)


def test_recorded_tenures(spark):
    from coordlytics.operators.lease import recorded_tenures

    rnd = random.Random(9)
    start, rows, want = datetime(2024, 1, 1), [], []
    as_of = start + timedelta(hours=400)
    for name in ("x", "y", "z"):
        t, held = start, None
        for i in range(300):
            t += timedelta(minutes=rnd.choice([0, 10, 60, 200]))
            holder = rnd.choice(["a", "a", "a", "b", "", None])
            ends = rnd.choice([None, t + timedelta(minutes=60), t + timedelta(minutes=120)])
            rows.append(("default", name, t, i, holder, ends))
            if held and held[3] is not None and held[3] < t:
                want.append((name, *held[:3], held[3], "ttl"))
                held = None
            if held and held[0] == (holder or None):
                held = (*held[:3], ends)
                continue
            if held:
                want.append((name, *held[:3], t, "handover" if holder else "clear"))
            held = (holder, i, t, ends) if holder else None
        if held:
            over = held[3] is not None and held[3] < as_of
            want.append((name, *held[:3], held[3] if over else None, "ttl" if over else "open"))
    df = spark.createDataFrame(rows, "ns string, name string, ts timestamp, seq long, holder string, expires_at timestamp")
    got = recorded_tenures(df, str(as_of)).select("name", "holder", "seq", "started_at", "ended_at", "end_reason").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dependent_values_take_one_summary(spark):
    """Shuffles of a phase timeline and a gate history do not double with every dependent value."""
    from coordlytics.plans.bindings import Tables
    from coordlytics.plans.registry import all_entries

    tables = Tables(spark, "/root/testdata/sf0.001")
    most = {"barrier_phase_timeline": 28, "gate_history": 140, "oversubscription": 12}
    for name, limit in most.items():
        plan = plan_of(all_entries()[name].run(tables))
        assert plan.count("Exchange hashpartitioning") <= limit, (name, plan.count("Exchange hashpartitioning"))


def test_a_summary_does_what_reads_and_writes_do():
    """Random logs entered in states that earlier random logs led to, against the operations one by one."""
    from coordlytics.operators.rwmutex import RWMutexFold, _copied

    rnd, fold = random.Random(5), RWMutexFold("outcomes")
    for _ in range(600):
        rows = [("rlock" if op == "lock" and rnd.random() < 0.6 else op, h or "d", *rest) for op, h, *rest in random_ops(rnd, rnd.randint(1, 14))]
        effect = fold.summary(rows)
        for _ in range(25):
            entering = fold.start()
            earlier = [("rlock" if op == "lock" and rnd.random() < 0.7 else op, h or "d", ts - 200, ttl, seq)
                       for op, h, ts, ttl, seq in random_ops(rnd, rnd.randint(0, 8), gap=20)]
            for row in earlier:
                entering = fold.step(entering, row, [].append)
            want = _copied(entering)
            for row in rows:
                want = fold.step(want, row, [].append)
            assert fold.through(effect, _copied(entering)) == want, (earlier, rows)


def test_day_sketches_merge_to_months(spark):
    """Merged sketches against exact answers, within the stated errors; and the same whether merged once or twice."""
    from coordlytics.functions import sketches as S

    rnd = random.Random(6)
    rows = [(f"k{i % 2}", i % 30, f"h{rnd.randrange(6000)}", int(rnd.expovariate(0.001))) for i in range(40000)] + [("k0", 3, None, None), ("few", 1, "a", 5)]
    df = spark.createDataFrame(rows, "name string, day int, holder string, hold long")
    days = df.groupBy("name", "day").agg(F.count("*").alias("n"), S.distinct_sketch("holder", "who"), S.quantile_sketch("hold", "held"))
    weeks = S.merged(days.withColumn("week", F.expr("day div 7")).drop("day"), ["name", "week"])
    for source in (days.drop("day"), weeks.drop("week")):
        got = {r["name"]: r for r in S.merged(source, ["name"]).select(
            "name", "n", S.distinct_estimate("who").alias("who"), *[S.quantile_estimate("held", p).alias(f"p{int(100 * p)}") for p in (0.5, 0.95)]).collect()}
        for name in ("k0", "k1"):
            own = [r for r in rows if r[0] == name]
            held = sorted(r[3] for r in own if r[3] is not None)
            assert got[name]["n"] == len(own)
            exact = len({r[2] for r in own if r[2]})
            assert abs(got[name]["who"] - exact) <= 4 * S.RELATIVE_ERROR * exact
            for p in (0.5, 0.95):
                found = got[name][f"p{int(100 * p)}"]
                low, high = sum(h < found for h in held) / len(held), sum(h <= found for h in held) / len(held)
                assert low - 2 * S.RANK_ERROR <= p <= high + 2 * S.RANK_ERROR
        assert tuple(got["few"])[1:] == (1, 1, 5, 5)
