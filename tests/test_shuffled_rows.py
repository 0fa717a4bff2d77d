"""How many rows are shuffled for logs of many small keys, and that busy keys get the same results by their own way."""

import math
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from coordlytics.operators import barrier, gate, semaphore
from coordlytics.operators.waits import wait_outcomes, wait_percentiles
from coordlytics.plans import ordered
from helpers import ARRIVALS, BARRIERS, GATES, at, frame

EVENTS = "ns string, name string, op string, holder string, ts timestamp, seq long, ttl interval day to second"


def shuffled(df):
    """The result, and the rows that its plan shuffled; an exchange that is used again counts once."""
    rows, seen = df.collect(), {}

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "ReusedExchangeExec":
            return walk(node.child())
        if kind == "ShuffleExchangeExec":
            seen[node.id()] = node.metrics().get("shuffleRecordsWritten").get().value()
        for some in (node.children(), node.subqueries()):
            for i in range(some.size()):
                walk(some.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return rows, sum(seen.values())


@pytest.fixture(params=["few", "busy", "some"])
def share(request, monkeypatch):
    """Which keys count as busy: none of a small log, all, or those of more rows than the others."""
    monkeypatch.setattr(ordered, "FEW_ROWS", {"few": 100_000, "busy": 0, "some": 30}[request.param])
    return request.param


def events(spark, keys, n, seed=1):
    rnd = random.Random(seed)
    rows = [("default", rnd.choice([f"s{i % keys}", f"s{i % keys}", "s0"]), rnd.choice(["acquire", "acquire", "release"]),
             rnd.choice(["a", "b", None]), None if rnd.random() < 0.01 else at(hours=rnd.randrange(200)), i, None) for i in range(n)]
    return frame(spark, EVENTS, rows).withColumn("ttl", F.expr("make_dt_interval(2)"))


def by_definition(rows):
    out, keys = [], {}
    for r in rows:
        keys.setdefault((r.ns, r.name, r.holder), []).append(r)
    for key, own in keys.items():
        own.sort(key=lambda r: (r.ts is not None, r.ts or at(), r.op == "acquire", r.seq))
        waiting, pairs = [], []
        for r in own:
            if r.op == "acquire":
                waiting.append(len(pairs))
                pairs.append([r.ts, None])
            elif waiting:
                pairs[waiting.pop(0)][1] = None if None in key else r.ts
        out += [(*key, *p) for p in pairs]
    return sorted(out, key=repr)


def test_permits_of_few_and_busy_keys(spark, share):
    df = events(spark, 60, 900)
    out, moved = shuffled(semaphore.permit_intervals(df))
    assert sorted(((r.ns, r.name, r.holder, r.acquired_at, r.released_at) for r in out), key=repr) == by_definition(df.collect())
    if share == "few":
        # once by key, and the counts; five times by (key, hour) and by ordinal
        assert 900 <= moved < 1.7 * 900


def test_usage_of_few_and_busy_keys(spark, share):
    df = events(spark, 60, 900, seed=2).filter("holder is not null")
    out, moved = shuffled(semaphore.holder_usage(semaphore.permit_intervals(df), str(at(hours=150))))
    now, want = at(hours=150), {}
    for *key, start, end in by_definition(df.collect()):
        if start is not None and start <= now:
            n, held = want.get(tuple(key), (0, 0))
            over = min(end or start + timedelta(days=2), start + timedelta(days=2))
            want[tuple(key)] = (n + 1, held + (int((over - start).total_seconds()) if over <= now else 0))
    assert {(r.ns, r.name, r.holder): (r.permits, r.total_hold_seconds or 0) for r in out} == want
    if share == "few":
        assert moved < 2 * df.count()


def waits_and_moves(spark, keys, n, seed=3):
    rnd = random.Random(seed)
    name = lambda i: rnd.choice([f"b{i % keys}", f"b{i % keys}", "b0", None])
    waiters = frame(spark, "ns string, name string, ts timestamp, seq long, timeout interval day to second", [
        ("default", name(i), at(hours=rnd.randrange(300)), i, timedelta(hours=rnd.randrange(60)) if i % 3 else None) for i in range(n)])
    moves = frame(spark, "ns string, name string, ts timestamp, phase string, seq long", [
        ("default", name(i), at(hours=rnd.randrange(300)), rnd.choice(["Open", "Failed", "Waiting"]), i) for i in range(n // 3)])
    return waiters, moves


def outcomes_by_definition(waiters, moves):
    out = []
    for w in waiters:
        own = sorted((m.ts, m.seq, m.phase) for m in moves if (m.ns, m.name) == (w.ns, w.name))
        ended = ("Open", "Failed")
        until = w.ts + (w.timeout if w.timeout is not None else timedelta(seconds=30))
        now = [p for t, _, p in own if t <= w.ts][-1:]
        later = [(t, p) for t, _, p in own if t > w.ts and p in ended][:1]
        if now and now[0] in ended:
            phase, end = now[0], w.ts
        elif later and later[0][0] <= until:
            phase, end = later[0][1], later[0][0]
        else:
            phase, end = "timeout", until
        out.append((w.ns, w.name, w.seq, {"Open": "opened", "Failed": "failed"}.get(phase, phase), int((end - w.ts).total_seconds())))
    return sorted(out, key=repr)


def test_waits_of_few_and_busy_keys(spark, share):
    waiters, moves = waits_and_moves(spark, 50, 600)
    out, moved = shuffled(wait_outcomes(waiters, moves))
    assert sorted(((r.ns, r.name, r.seq, r.outcome, r.wait_seconds) for r in out), key=repr) == outcomes_by_definition(waiters.collect(), moves.collect())
    if share == "few":
        assert moved < 1.7 * 800


def test_openings_of_few_and_busy_barriers(spark, share):
    rnd = random.Random(5)
    specs = [("default", None if i == 7 else f"b{i % 58}", at(hours=i % 9), 1 + i % 4, [None, 0, 2][i % 3], timedelta(hours=60) if i % 4 else None) for i in range(60)]
    came = [("default", rnd.choice([f"b{i % 55}", "b0", None]), rnd.choice(["x", "y", "z", "w", None]), at(hours=rnd.randrange(100)), i) for i in range(500)]
    barriers, arrivals = frame(spark, BARRIERS, specs), frame(spark, ARRIVALS, came)
    out, moved = shuffled(barrier.barrier_opened_at(barriers, arrivals))
    want = []
    for ns, name, created, expected, quorum, timeout in specs:
        required, firsts = expected if quorum is None else quorum, {}
        for _, b, h, t, s in came if name else []:
            if b == name:
                t0, s0 = firsts.get(h, (t, s))
                firsts[h] = (min(t, t0), min(s, s0))
        order = sorted((t, s, h) for h, (t, s) in firsts.items())
        nth = order[required - 1] if 1 <= required <= len(order) else None
        open_ = nth is not None and (timeout is None or nth[0] <= created + timeout)
        want.append((name, required, len(order), max(nth[0], created) if open_ else None, nth[2] if open_ else None))
    assert sorted(((r.name, r.required, r.arrived, r.opened_at, r.last_holder) for r in out), key=repr) == sorted(want, key=repr)
    if share == "few":
        assert moved < 1.7 * 560


def test_percentiles_of_few_and_busy_keys(spark, share):
    waiters, moves = waits_and_moves(spark, 50, 600, seed=4)
    groups = frame(spark, "ns string, name string, expected int", [("default", f"b{i}", i % 3) for i in range(50)])
    outcomes = wait_outcomes(waiters, moves)
    shared = outcomes.join(groups, ["ns", "name"])
    got = {r.expected: (r.opened, r.failed, r.timeout, r.p50, r.p95) for r in wait_percentiles(shared, ["expected"]).collect()}
    known = [r for r in outcomes_by_definition(waiters.collect(), moves.collect()) if r[1]]
    for k in range(3):
        own = [r for r in known if int(r[1][1:]) % 3 == k]
        times = sorted(r[4] for r in own)
        at_least = lambda q: times[max(0, math.ceil(q * len(times)) - 1)]
        assert got[k] == (*[sum(r[3] == o for r in own) for o in ("opened", "failed", "timeout")], at_least(0.5), at_least(0.95))
    if share == "few":
        # the waits once for their outcomes; behind them the join and the groups
        assert shuffled(shared)[1] < 2.9 * 800


def test_timelines_of_few_and_busy_keys(spark, share):
    rnd = random.Random(6)
    spans = [("default", rnd.choice([f"s{i % 40}", "s0", None]), at(hours=rnd.randrange(50)) if i % 50 else None,
              at(hours=50 + rnd.randrange(40)) if i % 7 else None) for i in range(600)]
    out, moved = shuffled(semaphore.in_use_timeline(frame(spark, "ns string, name string, acquired_at timestamp, ended_at timestamp", spans)))
    steps = {}
    for _, name, start, end in spans:
        for t, d in ((start, 1), (end, -1)):
            if t is not None:
                steps.setdefault(name, {}).setdefault(t, []).append(d)
    want = []
    for name, own in steps.items():
        level = 0
        for t in sorted(own):
            level += sum(own[t])
            if sum(own[t]):
                want.append((name, t, level))
    assert sorted(((r.name, r.ts, r.in_use) for r in out), key=repr) == sorted(want, key=repr)
    if share == "few":
        assert moved < 2 * 600  # spans and the counts, not their two ends several times


CHANGES = "type string, target_ns string, condition string, ts timestamp, seq long, phase string, available long, succeeded long"


def gates_and_changes(spark, n=40, seed=7):
    rnd = random.Random(seed)
    need = lambda r, v: dict(type="Semaphore", name=f"r{r}", namespace="", state="", value=v)
    specs = [("default", f"g{i}" if i else None, at(hours=i % 20), None, [need(rnd.randrange(12), rnd.randrange(1, 4)) for _ in range(i % 4)]) for i in range(n)]
    moves = [("Semaphore", "default", f"r{rnd.randrange(11)}" if i % 40 else None, at(minutes=7 * i), i, None, rnd.randrange(5), None) for i in range(400)]
    return frame(spark, GATES, specs), frame(spark, CHANGES, moves), specs, moves


def met_over_time(spec, moves):
    """(instant, number met) of a gate whenever one of its resources changes, and at its creation."""
    _, name, created, _, conditions = spec
    own, out = ([] if name is None else conditions), {}
    levels, met = {}, lambda: sum(levels.get(c["name"], 0) >= c["value"] for c in own)
    out[created] = 0
    for _, _, r, t, _, _, free, _ in moves:
        levels[r] = free
        out[max(t, created)] = met()
    return sorted(out.items()), len(own)


def test_gates_over_time_of_few_and_busy_keys(spark, share):
    gates, changes, specs, moves = gates_and_changes(spark)
    rows = gate.gate_history(gates, changes).collect()
    want = []
    for spec in specs:
        points, total = met_over_time(spec, moves)
        kept = [(t, n) for i, (t, n) in enumerate(points) if not i or (n == total) != (points[i - 1][1] == total)]
        want += [(spec[1], n == total, t, e, n) for (t, n), e in zip(kept, [*[t for t, _ in kept[1:]], None])]
    assert sorted(((r.name, r.open, r.started_at, r.ended_at, r.conditions_met) for r in rows), key=repr) == sorted(want, key=repr)


def test_first_instants_are_told_by_status(spark):
    """Of many changes to the same status only the first is joined to the conditions."""
    gates, changes, specs, moves = gates_and_changes(spark)
    joined = gate.first_met(gates, changes)
    got = {(r.condition, r["__value"]): r.met_at for r in joined.collect()}
    want = {}
    for *_, conditions in specs:
        for c in conditions:
            times = [t for _, _, r, t, _, _, free, _ in moves if r == c["name"] and free >= c["value"]]
            if times:
                want[(c["name"], str(c["value"]))] = min(times)
    assert got == want
    many = changes.unionByName(changes.withColumn("ts", F.expr("ts + interval 1 day"))).unionByName(changes.withColumn("ts", F.expr("ts + interval 2 days")))
    assert shuffled(gate.first_met(gates, many.coalesce(1)))[1] == shuffled(gate.first_met(gates, changes.coalesce(1)))[1]
