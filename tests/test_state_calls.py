"""Processors against a state that counts its calls: a key reads and writes what its rows touch once, not once a row."""

import pickle
import random
from datetime import datetime, timedelta

from pyspark.sql import Row, functions as F

from coordlytics.streaming import runtime, streams
from coordlytics.streaming.processors import FEW, BarrierProcessor, GateProcessor, SemaphoreProcessor
from helpers import GATES, T0, at, frame, got


class Table:
    """A map or value state in memory."""

    def __init__(self, calls):
        self.calls, self.rows = calls, {}

    def _called(self, out):
        self.calls[0] += 1
        return out

    def exists(self):
        return self._called(bool(self.rows))

    def get(self):
        return self._called(self.rows.get(()))

    def update(self, value):
        self._called(self.rows.update({(): value}))

    def clear(self):
        self._called(self.rows.clear())

    def containsKey(self, key):
        return self._called(key in self.rows)

    def getValue(self, key):
        return self._called(self.rows.get(key))

    def updateValue(self, key, value):
        self._called(self.rows.update({key: value}))

    def removeKey(self, key):
        self._called(self.rows.pop(key, None))


class Handle:
    def __init__(self):
        self.calls, self.tables, self.timers = [0], {}, set()

    def getValueState(self, name, *_):
        return self.tables.setdefault(name, Table(self.calls))

    getMapState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Clock:
    def __init__(self, ms=0):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def fed(processor, batches, key=("default", "k")):
    """What the batches give one after the other, and the calls to the state."""
    handle = Handle()
    processor.init(handle)
    out = [tuple(r) for batch in batches for r in processor.handleInputRows(key, iter(batch), Clock())]
    return out, handle.calls[0], {n: dict(t.rows) for n, t in handle.tables.items()}


def cut_up(rows, sizes):
    rest, out = list(rows), []
    for n in sizes:
        out.append(rest[:n])
        rest = rest[n:]
    return [*out, rest]


def test_a_semaphore_reads_and_writes_what_a_batch_touches():
    rnd, minute = random.Random(3), 60_000_000
    rows = []
    for i in range(4000):
        op = rnd.choice(["acquire", "acquire", "release"])
        rows.append(Row(ts_us=i // 3 * minute, op=op, seq=i, holder=f"h{rnd.randrange(5)}", ttl_us=rnd.choice([None, 20 * minute, 45 * minute, 3 * 60 * minute])))
    whole, calls, left = fed(SemaphoreProcessor(), [rows])
    # called for every row, the state took 43,264 calls here
    assert calls < 4000
    # batches end between instants, as the rows of one instant are ordered among themselves
    pieces, _, also = fed(SemaphoreProcessor(), cut_up(rows, [3, 6, 699, 0, 30, 1500]))
    assert (whole, left) == (pieces, also)


def test_a_gate_reads_and_writes_a_condition_once():
    rnd = random.Random(4)
    rows = [Row(ts_us=i, seq=i, pos=rnd.randrange(2), met=rnd.random() < 0.6) for i in range(3000)]

    def run(batches):
        handle, processor = Handle(), GateProcessor()
        processor.init(handle)
        processor.handleInitialState(("default", "g"), {"conditions_total": 2, "created_us": 0, "deadline_us": None, "blocks": 1}, Clock())
        out = [tuple(r) for batch in batches for r in processor.handleInputRows(("default", "g"), iter(batch), Clock())]
        return out, handle.calls[0]

    whole, calls = run([rows])
    assert calls < 20  # called for every row, the state took over 3,000
    assert len(whole) > 500 and whole == run(cut_up(rows, [1, 10, 0, 1500]))[0]


def test_equal_gates_are_followed_as_one(spark, tmp_path, monkeypatch):
    """Kinds of gates of more than one block, a gate listed twice and one without a name: each has its own rows, once."""
    need = lambda n: [dict(type="Semaphore", name=n, namespace="", state="", value=1)]
    names = [f"g{i}" for i in range(streams.BLOCK + 200)] + ["g0", None]
    gates = frame(spark, GATES, [("default", n, T0, timedelta(minutes=10), need("s")) for n in names] + [
        ("default", "other", T0, None, need("s")), ("default", "quiet", T0, timedelta(minutes=1), need("t"))])
    followed = []
    listed = streams.exploded_conditions
    monkeypatch.setattr(streams, "exploded_conditions", lambda g: (followed.append(g), listed(g))[1])
    schema = "kind string, ns string, name string, ts timestamp, seq long, phase string, available long, succeeded long"
    for i, (second, free) in enumerate([(30, 1), (60, 0), (3600, 0)]):
        frame(spark, schema, [("Semaphore", "default", "s", at(seconds=second), i, None, free, None)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = runtime.drain(streams.gate_phase_stream(stream, gates, "0 seconds"), "t")
    assert followed[0].count() == 3  # one of each kind
    steps = [(at(seconds=30), "Open", 1, 1), (at(seconds=60), "Waiting", 0, 1), (at(minutes=10), "Failed", 0, 1)]
    want = [("default", n, *s) for n in {*names} for s in steps] + [("default", "other", *s) for s in steps[:2]] + [
        ("default", "quiet", at(minutes=1), "Failed", 0, 1)]
    assert got(out, "ns", "name", "ts", "phase", "conditions_met", "conditions_total") == sorted(want, key=repr)


def test_the_gates_of_the_registered_stream_are_a_batch_table(spark, monkeypatch):
    from coordlytics.plans.bindings import Tables
    from coordlytics.plans.registry import all_entries

    seen = []
    monkeypatch.setattr(streams, "gate_phase_stream", lambda changes, gates, *_: seen.append((changes.isStreaming, gates.isStreaming)) or changes)
    monkeypatch.setattr(runtime, "drain", lambda stream, label: stream)
    all_entries()["gate_phase_stream"].run(Tables(spark, "/root/testdata/sf0.001"))
    assert seen == [(True, False)]


def shard_rows(spark, rows):
    """Rows of a barrier log as the processor gets them; all barriers are given to one key."""
    schema = "ns string, name string, op string, holder string, ts timestamp, seq long, required int, deadline timestamp"
    df = frame(spark, schema, rows)
    # the part of a barrier goes by its name, as it does in the stream
    part = F.pmod(F.xxhash64("ns", "name"), F.lit(4))
    return df.select("seq", streams.packed_barrier(part).alias("packed")).orderBy("seq").collect()


def test_a_shard_of_barriers_calls_the_state_once_a_part(spark):
    rnd = random.Random(8)
    rows, seq = [], 0
    for b in range(400):
        for h in [None, *rnd.sample(["x", "y", "z", "", None], 3)]:
            seq += 1
            op = "create" if seq % 4 == 1 else "arrive"
            rows.append(("a,b:" if b % 7 else None, f"b:{b},", op, h, at(seconds=seq), seq, 2 + b % 3 if op == "create" else None, at(seconds=seq + 2) if op == "create" and b % 5 == 0 else None))
    came = shard_rows(spark, rows)
    whole, calls, left = fed(BarrierProcessor(), [came], (0,))
    assert calls < 60  # a key of its own for every barrier made over 2,000 calls
    pieces, _, also = fed(BarrierProcessor(), cut_up(came, [1, 7, 0, 500, 200]), (0,))
    unpacked = lambda tables: {k[0]: pickle.loads(v[0]) for k, v in tables["barriers"].items()}
    assert whole and sorted(whole, key=repr) == sorted(pieces, key=repr) and unpacked(left) == unpacked(also)
    # one after the other, by the definition
    want = []
    for b in range(400):
        create, *arrived = rows[4 * b: 4 * b + 4]
        in_time, holders, deadline = [], set(), create[7]
        for r in arrived:
            if deadline is not None and deadline < r[4]:
                break
            holders.add(r[3])
            in_time.append((len(holders), r[4]))
        opened = next(((n, t) for n, t in in_time if n >= create[6]), None)
        if opened:
            want.append((create[0], create[1], "Open", opened[1], opened[0]))
        elif deadline is not None:
            want.append((create[0], create[1], "Failed", deadline, len(holders)))
    us = lambda t: int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    assert sorted(whole, key=repr) == sorted(((n, m, p, us(t), k) for n, m, p, t, k in want), key=repr)


def test_many_holders_of_a_barrier_are_read_by_slot(spark):
    """A barrier of very many holders: an arrival reads few of them, repeats do not count, all are gone once it is open."""
    holders = [f"h{i}" for i in range(1000)]
    rows = [("default", "b", "create", None, T0, 0, 1001, None)] + [
        ("default", "b", "arrive", h, at(seconds=1 + i), 1 + i, None, None) for i, h in enumerate([*holders, *holders])]
    came = shard_rows(spark, [*rows, ("default", "b", "arrive", "last", at(hours=2), 9000, None, None)])
    handle, processor = Handle(), BarrierProcessor()
    processor.init(handle)
    assert not list(processor.handleInputRows((0,), iter(came[:-1]), Clock()))
    kept = [pickle.loads(v[0]) for v in handle.tables["holders"].rows.values()]
    assert sorted(h for some in kept for h in some) == sorted(holders) and max(map(len, kept)) < 4 * FEW
    before = handle.calls[0]
    assert not list(processor.handleInputRows((0,), iter(came[5:6]), Clock())) and handle.calls[0] - before < 10
    assert [tuple(r)[2:] for r in processor.handleInputRows((0,), iter(came[-1:]), Clock())] == [("Open", 1704117600000000, 1001)]
    assert not handle.tables["holders"].rows
