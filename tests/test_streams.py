"""Streams fed file by file against the batch operators on the same log."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from coordlytics.functions.columns import parse_durations
from coordlytics.operators import barrier, lease, mutex, rwmutex, semaphore, validate, waitgroup
from coordlytics.operators.relations import where_condition
from coordlytics.sources.specs import EVENT_SCHEMA, read_events, typed
from coordlytics.streaming import runtime, streams
from helpers import BARRIERS, GATES, LOCK_OPS, T0, at, frame, got

LOG = LOCK_OPS + ", priority int, delta int"


def log_rows(ops, n=240, gap=50, seed=5):
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rnd.randrange(1, gap)
        rows.append(("default", rnd.choice(["hot", "hot", "hot", "cold"]), rnd.choice(ops), f"h{rnd.randrange(3)}", at(seconds=t), i, None, i % 4, i % 5 - 2))
    return rows


def log(spark, ops, ttl=120, **more):
    return frame(spark, LOG, log_rows(ops, **more)).withColumn("ttl", F.expr(f"make_dt_interval(0, 0, 0, {ttl})"))


def as_stream(spark, df, folder, parts=4, order="seq"):
    """The log as consecutive files, read one per micro-batch. The last one lies far ahead."""
    total = df.count()
    for i in range(parts):
        df.orderBy(order).withColumn("__i", F.expr("row_number() over (order by seq) - 1")).filter(
            f"__i >= {i * total // parts} and __i < {(i + 1) * total // parts}").drop("__i").coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_mutex_stream(spark, tmp_path):
    df = log(spark, ["lock", "lock", "unlock"])
    out = runtime.drain(streams.mutex_stream(as_stream(spark, df, tmp_path / "in"), "0 seconds"), "t")
    cols = ["name", "seq", "outcome", "blocked_by", "locked_at"]
    assert got(out.filter("op <> 'expire'"), *cols) == got(mutex.mutex_replay(df), *cols)
    tenures = mutex.mutex_tenures(df).filter("end_reason = 'ttl'")
    expired = got(out.filter("op = 'expire'"), "name", "holder", "ts")
    assert expired and set(got(tenures, "name", "holder", "ended_at")) <= set(expired)


def test_rwmutex_stream(spark, tmp_path):
    df = log(spark, ["rlock", "rlock", "lock", "unlock", "unlock"])
    out = runtime.drain(streams.rwmutex_stream(as_stream(spark, df, tmp_path / "in"), "0 seconds"), "t")
    cols = ["name", "seq", "outcome", "readers", "writer", "expires_at"]
    assert got(out.filter("op <> 'expire'"), *cols) == got(rwmutex.rwmutex_replay(df), *cols)


def test_lease_stream(spark, tmp_path):
    df = log(spark, ["request", "request", "clear"])
    out = runtime.drain(streams.lease_stream(as_stream(spark, df, tmp_path / "in"), "0 seconds"), "t")
    end = df.agg(F.max("ts")).first()[0]
    cols = ["name", "holder", "priority", "started_at", "ended_at", "end_reason"]
    batch = lease.lease_tenures(df, str(end)).filter("ended_at is not null")
    assert got(out, *cols) == got(batch, *cols)


def test_waitgroup_stream(spark, tmp_path):
    df = log(spark, ["x"])
    out = runtime.drain(streams.waitgroup_stream(as_stream(spark, df, tmp_path / "in"), "0 seconds"), "t")
    cols = ["name", "seq", "counter", "lost"]
    assert got(out, *cols) == got(waitgroup.waitgroup_counter(df), *cols)


def test_semaphore_stream(spark, tmp_path):
    df = log(spark, ["acquire", "acquire", "release"], ttl=200)
    out = runtime.drain(streams.semaphore_stream(as_stream(spark, df, tmp_path / "in"), "0 seconds"), "t")
    end = df.agg(F.max("ts")).first()[0]
    batch = semaphore.in_use_timeline(semaphore.permit_intervals(df)).filter(F.col("ts") <= end)
    assert got(out, "name", "ts", "in_use") == got(batch, "name", "ts", "in_use")


def test_barrier_stream(spark, tmp_path):
    specs = [("default", f"b{i}", at(seconds=40 * i), 3, 2 if i % 2 else None, None if i % 3 == 0 else timedelta(seconds=100)) for i in range(30)]
    rnd = random.Random(1)
    arrivals = sorted((at(seconds=40 * b + rnd.randrange(0, 200)), f"b{b}", f"h{rnd.randrange(4)}") for b in range(30) for _ in range(4))
    b = frame(spark, BARRIERS, specs)
    a = frame(spark, "ns string, barrier string, holder string, arrived_at timestamp, seq long", [("default", n, h, ts, i) for i, (ts, n, h) in enumerate(arrivals)])
    created = b.selectExpr("ns", "name", "'create' as op", "cast(null as string) as holder", "created_at as ts", "-1L as seq", "coalesce(quorum, expected) as required", "created_at + timeout as deadline")
    came = a.selectExpr("ns", "barrier as name", "'arrive' as op", "holder", "arrived_at as ts", "seq", "cast(null as int) as required", "cast(null as timestamp) as deadline")
    rows = created.unionByName(came).withColumn("seq", F.expr("cast(row_number() over (order by ts, seq) as bigint)"))
    out = runtime.drain(streams.barrier_stream(as_stream(spark, rows, tmp_path / "in"), "0 seconds"), "t")
    opened = barrier.barrier_opened_at(b, a)
    assert got(out.filter("phase = 'Open'"), "name", "ts") == got(opened.filter("opened_at is not null"), "name", "opened_at")
    end = rows.agg(F.max("ts")).first()[0]
    failed = opened.filter(F.col("opened_at").isNull() & (F.col("deadline") <= F.lit(end)))
    assert set(got(out.filter("phase = 'Failed'"), "name", "ts")) == set(got(failed, "name", "deadline"))
    assert failed.count() > 0


def test_once_and_heartbeats(spark, tmp_path):
    df = log(spark, ["x"], ttl=300)
    firsts = runtime.drain(streams.once_stream(as_stream(spark, df, tmp_path / "in"), "0 seconds"), "t")
    want, until = [], {}
    for r in sorted(df.collect(), key=lambda r: r.seq):
        if r.name not in until or r.ts > until[r.name]:
            until[r.name] = r.ts + r.ttl
            want.append((r.name, r.seq))
    assert got(firsts, "name", "seq") == sorted(want, key=repr)
    again = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    reigns = runtime.drain(streams.heartbeat_stream(again, "0 seconds"), "t")
    batch = set(got(lease.heartbeat_sessions(df), "name", "holder", "started_at", "ended_at", "renew_count"))
    online = set(got(reigns, "name", "holder", "started_at", "ended_at", "renew_count"))
    # reigns still open when the stream ends are not written
    assert online and online <= batch and len(batch - online) <= 6


def shuffled(spark, df, folder, lateness=600, parts=3, seed=3):
    """The log in files whose rows are out of order by less than ``lateness`` seconds, and a last one far ahead."""
    rnd = random.Random(seed)
    rows = sorted((r for r in df.collect()), key=lambda r: r.ts.timestamp() + rnd.uniform(0, lateness - 1))
    assert [r.seq for r in rows] != sorted(r.seq for r in rows)
    ahead = [r.asDict() | {"name": "ahead", "ts": max(r.ts for r in rows) + timedelta(days=30), "seq": 10**6} for r in rows[:1]]
    n = len(rows)
    for i, part in enumerate([rows[k * n // parts: (k + 1) * n // parts] for k in range(parts)] + [ahead, ahead]):
        if part:
            spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.mark.parametrize("kind", ["mutex", "rwmutex", "lease", "semaphore", "waitgroup", "once", "barrier"])
def test_shuffled_files_give_what_the_batch_gives(spark, tmp_path, kind):
    """Rows up to ten minutes late, over many micro-batches, against the batch operator or a loop on the sorted log."""
    ops = {"mutex": ["lock", "lock", "unlock"], "rwmutex": ["rlock", "rlock", "lock", "unlock", "unlock"], "lease": ["request", "request", "clear"],
           "semaphore": ["acquire", "acquire", "release"], "waitgroup": ["x"], "once": ["x"]}
    if kind == "barrier":
        specs = [("default", f"b{i}", at(seconds=40 * i), 3, 2 if i % 2 else None, None if i % 3 == 0 else timedelta(seconds=100)) for i in range(30)]
        rnd = random.Random(1)
        arrivals = sorted((at(seconds=40 * b + rnd.randrange(0, 200)), f"b{b}", f"h{rnd.randrange(4)}") for b in range(30) for _ in range(4))
        b = frame(spark, BARRIERS, specs)
        a = frame(spark, "ns string, barrier string, holder string, arrived_at timestamp, seq long", [("default", n, h, ts, i) for i, (ts, n, h) in enumerate(arrivals)])
        created = b.selectExpr("ns", "name", "'create' as op", "cast(null as string) as holder", "created_at as ts", "-1L as seq", "coalesce(quorum, expected) as required", "created_at + timeout as deadline")
        came = a.selectExpr("ns", "barrier as name", "'arrive' as op", "holder", "arrived_at as ts", "seq", "cast(null as int) as required", "cast(null as timestamp) as deadline")
        rows = created.unionByName(came).withColumn("seq", F.expr("cast(row_number() over (order by ts, seq) as bigint)"))
        out = runtime.drain(streams.barrier_stream(shuffled(spark, rows, tmp_path / "in"), "10 minutes"), "t").filter("name <> 'ahead'")
        opened = barrier.barrier_opened_at(b, a)
        assert got(out.filter("phase = 'Open'"), "name", "ts") == got(opened.filter("opened_at is not null"), "name", "opened_at")
        assert got(out.filter("phase = 'Failed'"), "name", "ts") == got(opened.filter("opened_at is null and deadline is not null"), "name", "deadline")
        return
    df = log(spark, ops[kind], ttl=200)
    out = runtime.drain(getattr(streams, f"{kind}_stream")(shuffled(spark, df, tmp_path / "in"), "10 minutes"), "t").filter("name <> 'ahead'")
    end = df.agg(F.max("ts")).first()[0]
    if kind == "mutex":
        cols = ["name", "seq", "outcome", "blocked_by", "locked_at"]
        assert got(out.filter("op <> 'expire'"), *cols) == got(mutex.mutex_replay(df), *cols)
        ended = mutex.mutex_tenures(df, str(end + timedelta(days=1))).filter("end_reason = 'ttl'")
        assert got(out.filter("op = 'expire'"), "name", "holder", "ts") == got(ended, "name", "holder", "ended_at")
    elif kind == "rwmutex":
        cols = ["name", "seq", "outcome", "readers", "writer", "expires_at"]
        assert got(out.filter("op <> 'expire'"), *cols) == got(rwmutex.rwmutex_replay(df), *cols)
    elif kind == "lease":
        cols = ["name", "holder", "priority", "started_at", "ended_at", "end_reason"]
        batch = lease.lease_tenures(df, str(end + timedelta(days=29)))
        assert got(out, *cols) == got(batch, *cols)
    elif kind == "semaphore":
        batch = semaphore.in_use_timeline(semaphore.permit_intervals(df))
        assert got(out, "name", "ts", "in_use") == got(batch, "name", "ts", "in_use")
    elif kind == "waitgroup":
        assert got(out, "name", "seq", "counter", "lost") == got(waitgroup.waitgroup_counter(df), "name", "seq", "counter", "lost")
    else:
        want, until = [], {}
        for r in sorted(df.collect(), key=lambda r: r.seq):
            if r.name not in until or r.ts > until[r.name]:
                until[r.name] = r.ts + r.ttl
                want.append((r.name, r.seq))
        assert got(out, "name", "seq") == sorted(want, key=repr)


def test_upsert_is_idempotent(spark, tmp_path):
    df = log(spark, ["x"]).select("ns", "name", "ts", "seq", "holder")
    stream = as_stream(spark, df, tmp_path / "in")
    for attempt in ("first", "second"):
        # another checkpoint delivers every batch again
        runtime.upsert_status(stream, str(tmp_path / "out"), str(tmp_path / attempt)).awaitTermination()
        latest = runtime.read_status(spark, str(tmp_path / "out"))
        assert got(latest, "name", "seq") == got(df.groupBy("name").agg(F.max("seq").alias("seq")), "name", "seq")


def test_batches_run_once(spark, tmp_path):
    df = log(spark, ["x"]).select("ns", "name", "ts", "seq")
    stream = as_stream(spark, df, tmp_path / "in")
    seen = []

    def failing(batch, batch_id):
        if batch_id == 2 and 2 not in seen:
            seen.append(2)
            raise RuntimeError("once")
        seen.append((batch_id, batch.count()))

    def run(checkpoint):
        runtime.run_once_per_batch(stream, "job", str(tmp_path / "ledger"), str(tmp_path / checkpoint), failing).awaitTermination()

    with pytest.raises(Exception):
        run("one")
    run("one")  # the failed batch was not claimed and runs now
    done = [s for s in seen if s != 2]
    assert sorted(b for b, _ in done) == [0, 1, 2, 3] and sum(n for _, n in done) == df.count()
    run("two")  # a replay from the start finds all batches claimed
    assert [s for s in seen if s != 2] == done


def test_gate_stream(spark, tmp_path):
    conds = lambda i: [dict(type="Barrier", name=f"b{i}", namespace="", state="Open", value=None), dict(type="Semaphore", name="s", namespace="", state="", value=2)]
    gates = frame(spark, GATES, [("default", f"g{i}", T0, None, conds(i)) for i in range(4)])
    changes = frame(spark, "kind string, ns string, name string, ts timestamp, seq long, phase string, available long, succeeded long", [
        ("Barrier", "default", "b0", at(seconds=1), 1, "Open", None, None), ("Semaphore", "default", "s", at(seconds=2), 2, None, 3, None),
        ("Barrier", "default", "b1", at(seconds=3), 3, "Open", None, None), ("Semaphore", "default", "s", at(seconds=4), 4, None, 1, None)])
    path = str(tmp_path / "out")
    streams.gate_stream(as_stream(spark, changes, tmp_path / "in"), gates, "ts", path, str(tmp_path / "cp")).awaitTermination()
    written = spark.read.parquet(f"{path}/gates")
    # each change only touches the gates that name the resource
    assert got(written.groupBy("batch_id").count(), "batch_id", "count") == [(0, 1), (1, 4), (2, 1), (3, 4)]
    assert got(written.filter("phase = 'Open'"), "batch_id", "name") == [(1, "g0"), (2, "g1")]
    assert got(runtime.latest_rows(written, ["ns", "name"], ["ts"]), "name", "conditions_met") == [("g0", 1), ("g1", 1), ("g2", 0), ("g3", 0)]


def test_gate_stream_continues(spark, tmp_path):
    """A second run adds its batches under their own numbers and leaves those of the first as they are."""
    conds = [dict(type="Semaphore", name="s", namespace="", state="", value=2)]
    gates = frame(spark, GATES, [("default", "g", T0, None, conds)])
    schema = "kind string, ns string, name string, ts timestamp, seq long, phase string, available long, succeeded long"
    path = str(tmp_path / "out")
    for seq, free in ((1, 0), (2, 3)):
        frame(spark, schema, [("Semaphore", "default", "s", at(seconds=seq), seq, None, free, None)]).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.gate_stream(stream, gates, "ts", path, str(tmp_path / "cp")).awaitTermination()
    assert got(spark.read.parquet(f"{path}/gates"), "batch_id", "name", "phase") == [(0, "g", "Waiting"), (1, "g", "Open")]


def test_late_rows_are_kept(spark, tmp_path):
    a = frame(spark, "ns string, barrier string, holder string, arrived_at timestamp, seq long", [
        ("default", "b", "x", at(hours=9), 0), ("default", "b", "y", at(hours=-9), 1), ("default", "b", "z", at(hours=1), 2), ("default", "b", "w", at(hours=1, seconds=1), 3)])
    specs = frame(spark, BARRIERS, [("default", "b", T0, 2, None, timedelta(hours=1))])
    out = runtime.drain(streams.late_arrivals(as_stream(spark, a, tmp_path / "in", order="seq"), specs), "t")
    assert got(out, "holder", "late") == [("w", True), ("x", True), ("y", False), ("z", False)]


def test_rules_apply_to_streams(spark, tmp_path):
    df = frame(spark, "ns string, name string, expected int, quorum int, timeout string, seq long", [
        ("default", "a", 0, None, "1h", 0), ("default", "b", 2, 3, "1h", 1), ("default", "c", 2, 1, "later", 2), ("default", "d", 2, 1, "5m", 3)])
    stream = as_stream(spark, df, tmp_path / "in")
    assert got(runtime.drain(validate.validate_specs(stream, "barrier"), "t"), "name", "rule") == [
        ("a", "expected_min"), ("b", "quorum_max"), ("c", "timeout_duration")]
    parsed = runtime.drain(where_condition(parse_durations(stream, "timeout"), "timeout_valid and expected > 1").select("name"), "t")
    assert got(parsed, "name") == [("b",), ("d",)]


def test_event_log_batch_and_stream(spark, tmp_path):
    df = frame(spark, LOCK_OPS, [("default", "m", "lock", "h", at(seconds=i), i, None) for i in range(6)])
    typed(df, EVENT_SCHEMA, {c: c for c in df.columns}).write.parquet(str(tmp_path / "log"))
    batch = read_events(spark, str(tmp_path / "log"))
    stream = runtime.drain(read_events(spark, str(tmp_path / "log"), stream=True), "t")
    assert batch.count() == 6 and got(batch, "name", "op", "seq") == got(stream, "name", "op", "seq")


def test_status_table_versions(spark, tmp_path):
    """A replayed batch changes nothing, old files go, and the files of a version do not grow with the batches."""
    from coordlytics.streaming.status_table import KEPT, StatusTable

    table = StatusTable(spark, str(tmp_path / "t"), ["ns", "name"], ["ts", "seq"], buckets=4)
    want, rnd = {}, random.Random(2)
    schema = "ns string, name string, ts timestamp, seq long, phase string"
    sizes = []
    for batch in range(8):
        rows = [("default", f"k{rnd.randrange(30)}", at(seconds=rnd.randrange(500)), 100 * batch + i, rnd.choice("ab")) for i in range(25)]
        df = frame(spark, schema, rows)
        assert table.merge(df, "writer", batch)
        for r in rows:
            want[r[1]] = max(want.get(r[1], r), r, key=lambda x: (x[2], x[3]))
        before = table.current()
        assert not table.merge(df, "writer", batch) and table.current() == before
        assert got(table.read(), "name", "seq", "phase") == sorted((r[1], r[3], r[4]) for r in want.values())
        sizes.append(len(before["folders"]))
    assert max(sizes) <= 4 and len(table.versions()) == KEPT
    assert len([p for p in (tmp_path / "t" / "data").glob("*/*") if p.is_dir()]) <= 4 * KEPT
    # the same rows from another writer merge to the same table; an empty batch is a version without new files
    assert table.merge(df, "another", 0)
    assert got(table.read(), "name", "seq", "phase") == sorted((r[1], r[3], r[4]) for r in want.values())
    assert table.merge(df.limit(0), "another", 1)
    assert table.read().count() == len(want)


def test_gate_phases_without_changes(spark, tmp_path):
    """Gates whose resources never change fail at their deadlines, one without conditions opens, late changes count in order."""
    need = lambda n, v: ("Semaphore", n, "", "", v)
    gates = frame(spark, GATES, [
        ("default", "quiet", T0, timedelta(minutes=10), [need("nobody", 1)]), ("default", "empty", at(seconds=5), timedelta(minutes=10), []),
        ("default", "both", T0, timedelta(minutes=10), [need("s", 2), need("r", 1)]), ("default", "patient", T0, None, [need("s", 3)]),
        ("default", "late", T0, timedelta(minutes=10), [need("r", 5)])])
    log = [  # out of order within ten minutes, over three files
        [("r", 60, 1), ("s", 200, 2), ("s", 30, 0)], [("s", 120, 3), ("r", 400, 0), ("unnamed", 500, 1)], [("r", 700, 5), ("s", 650, 0)]]
    schema = "kind string, ns string, name string, ts timestamp, seq long, phase string, available long, succeeded long"
    seq = 0
    for part in [*log, [("unnamed", 9000, 0)], [("unnamed", 9001, 0)]]:
        rows = []
        for name, second, free in part:
            seq += 1
            rows.append(("Semaphore", "default", name, at(seconds=second), seq, None, free, None))
        frame(spark, schema, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = got(runtime.drain(streams.gate_phase_stream(stream, gates, "10 minutes"), "t"), "name", "ts", "phase", "conditions_met", "conditions_total")
    assert out == sorted([
        ("quiet", at(minutes=10), "Failed", 0, 1), ("empty", at(seconds=5), "Open", 0, 0),
        ("both", at(seconds=120), "Open", 2, 2), ("both", at(seconds=400), "Waiting", 1, 2), ("both", at(minutes=10), "Failed", 1, 2),
        ("patient", at(seconds=120), "Open", 1, 1), ("patient", at(seconds=200), "Waiting", 0, 1),
        ("late", at(minutes=10), "Failed", 0, 1), ("late", at(seconds=700), "Open", 1, 1)], key=repr)
