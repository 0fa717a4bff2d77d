"""ST1-ST10, O6 and the streaming form of IO7: streams in, streams out.

``delay`` says how late a row may come. The stateful streams hold rows for so long and then apply them in
order, so their output does not depend on files and micro-batches; with a delay of zero the log is
taken to be in order, and answers come at once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from coordlytics.functions.columns import micros
from coordlytics.operators.gate import condition_met, exploded_conditions, gate_conditions, gate_status
from coordlytics.operators.lease import LeaseFold, given_priority
from coordlytics.operators.mutex import MutexFold, as_timestamps, with_micros
from coordlytics.operators.relations import KEY
from coordlytics.operators.rwmutex import RWMutexFold
from coordlytics.plans.ordered import Fold
from coordlytics.streaming.processors import (
    PARTS, SHARDS, BarrierProcessor, CounterFold, FirstFold, FoldProcessor, GateProcessor, LeaseProcessor, SemaphoreProcessor)
from coordlytics.streaming.runtime import latest_rows, use_rocksdb
from coordlytics.streaming.status_table import StatusTable

LATENESS = "10 minutes"


def held(delay: str) -> bool:
    """Whether rows have to wait for the watermark: not if the log is in order."""
    return not re.fullmatch(r"\s*0+\s*\w+\s*", delay)


def _stateful(rows: DataFrame, processor, delay: str, keys: list[str] = KEY) -> DataFrame:
    use_rocksdb(rows.sparkSession)
    return rows.withWatermark("ts", delay).groupBy(*keys).transformWithState(
        statefulProcessor=processor, outputStructType=processor.output, outputMode="append", timeMode="EventTime")


def _folded(log: DataFrame, fold: Fold, times: list[str], delay: str) -> DataFrame:
    needed = list(dict.fromkeys([*KEY, "ts", "ts_us", "seq", *fold.inputs]))
    rows = with_micros(log).select(*needed)
    return as_timestamps(_stateful(rows, FoldProcessor(fold, KEY, held(delay)), delay), times)


def packed_barrier(part: Column) -> Column:
    """A row of a barrier log as one text, since every column of a row costs as much as the row's work.

    Numbers and the lengths of texts come first, an absent one is empty; then the texts.
    """
    texts = ["ns", "name", "holder"]
    # create rows sort after arrivals of the same instant, which then count as early
    created = F.coalesce(F.col("op") == "create", F.lit(False)).cast("int")
    numbers = [micros("ts"), created, F.col("seq"), F.col("required"), micros("deadline"), part, *[F.length(t) for t in texts]]
    said = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.concat_ws(",", *[said(n) for n in numbers]), F.lit(":"), *[said(F.col(t)) for t in texts])


def barrier_stream(log: DataFrame, delay: str = LATENESS) -> DataFrame:
    """ST1: one row when a barrier opens, one when it fails.

    ``log`` has ns, name, op (create or arrive), holder, ts, seq, required and deadline.
    """
    dealt = F.xxhash64(*KEY)
    rows = log.select(F.pmod(dealt, F.lit(SHARDS)).alias("shard"), "ts", packed_barrier(F.pmod(F.shiftright(dealt, 32), F.lit(PARTS))).alias("packed"))
    return as_timestamps(_stateful(rows, BarrierProcessor(held(delay)), delay, ["shard"]), ["ts"])


def mutex_stream(ops: DataFrame, delay: str = LATENESS) -> DataFrame:
    """ST2: outcome of every operation, and an expired row when a ttl frees the lock."""
    return _folded(ops, MutexFold("outcomes", announce=True), ["ts", "locked_at", "expires_at"], delay)


def rwmutex_stream(ops: DataFrame, delay: str = LATENESS) -> DataFrame:
    """ST3: outcome of every operation, and an expired row when the shared ttl frees the lock."""
    return _folded(ops, RWMutexFold("outcomes", announce=True), ["ts", "expires_at"], delay)


def lease_stream(log: DataFrame, delay: str = LATENESS) -> DataFrame:
    """ST4: every tenure when it ends; the next request is granted at that instant."""
    rows = with_micros(log.withColumn("priority", given_priority().cast("long"))).select(
        *KEY, "ts", "ts_us", "seq", "op", "priority", "ttl_us", "holder")
    return as_timestamps(_stateful(rows, LeaseProcessor(LeaseFold(), held(delay)), delay), ["started_at", "ended_at"])


def semaphore_stream(log: DataFrame, delay: str = LATENESS) -> DataFrame:
    """ST5: permits in use after every change, expiries included."""
    rows = with_micros(log).select(*KEY, "ts", "ts_us", "op", "seq", "holder", "ttl_us")
    return as_timestamps(_stateful(rows, SemaphoreProcessor(held(delay)), delay), ["ts"])


def waitgroup_stream(deltas: DataFrame, delay: str = LATENESS) -> DataFrame:
    """ST6: the clamped counter and its phase after every change."""
    return _folded(deltas.withColumn("delta", F.col("delta").cast("long")), CounterFold(), ["ts"], delay)


def once_stream(events: DataFrame, delay: str = LATENESS) -> DataFrame:
    """The first event of each key, and again once the key's ttl has passed."""
    return _folded(events, FirstFold(), ["ts"], delay)


def dedupe_creates_stream(events: DataFrame, delay: str = LATENESS, keys: list[str] = ["ns", "kind", "name"]) -> DataFrame:
    """IO7: creates without repeats; state is dropped once the watermark has passed."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def contention_stream(outcomes: DataFrame, width: str, slide: str | None = None, delay: str = LATENESS) -> DataFrame:
    """ST8, M5: attempts and rejections per mutex in tumbling or sliding windows."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return outcomes.withWatermark("ts", delay).groupBy(*KEY, span.alias("w")).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(~F.col("ok")).alias("rejections"),
        F.approx_count_distinct("holder").alias("contenders")
    ).select(*KEY, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "attempts", "rejections", "contenders")


def heartbeat_stream(heartbeats: DataFrame, delay: str = LATENESS, keys: list[str] = [*KEY, "holder"]) -> DataFrame:
    """ST9: reigns online; a renewal at the instant of expiry still continues one.

    The session gap is the row's own ttl, which session windows take as a calendar interval.
    """
    # the ttl as days and seconds keeps every interval below the calendar type's limits
    epoch = F.timestamp_micros(F.lit(0))
    seconds = (F.unix_micros(epoch + F.col("ttl")) / 1_000_000).cast("decimal(18,6)")
    zero = F.lit(0)
    gap = F.make_interval(zero, zero, zero, zero, zero, zero, seconds)
    return heartbeats.withWatermark("ts", delay).groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(
        (F.count(F.lit(1)) - 1).alias("renew_count")
    ).select(*keys, F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "renew_count")


def late_arrivals(arrivals: DataFrame, specs: DataFrame) -> DataFrame:
    """ST10: every arrival tagged with whether its barrier's deadline had passed.

    A stream-static join without watermark: nothing is dropped for being late.
    """
    static = specs.select("ns", F.col("name").alias("barrier"), (F.col("created_at") + F.col("timeout")).alias("deadline"))
    joined = arrivals.join(static, ["ns", "barrier"])
    return joined.withColumn("late", F.coalesce(F.col("arrived_at") > F.col("deadline"), F.lit(False)))


#: Gates of a kind that one row of a phase change is joined to in one task.
BLOCK = 256


def _kinds(gates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gates that wait for the same, from the same time on and as long, are of one kind, led by the least of them.

    Gives the leading gates, as ``gates`` has them, with the number of blocks that their kind takes; and for every gate its leader and block.
    """
    spec = F.struct("conditions", "created_at", "timeout")
    named = gates.groupBy(*KEY).agg(F.array_sort(F.collect_set(spec)).alias("specs"))
    kinds = named.groupBy("ns", "specs").agg(
        F.min(F.struct("name"))["name"].alias("leader"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    leaders = kinds.select("ns", F.col("leader").alias("name"), "blocks", F.inline("specs"))
    of = kinds.select(F.col("ns").alias("__ns"), F.col("specs").alias("__specs"), "leader", "blocks")
    members = named.join(of, F.col("ns").eqNullSafe(F.col("__ns")) & (F.col("specs") == F.col("__specs"))).select(
        F.col("ns").alias("__ns"), F.col("name").alias("__name"), "leader", F.pmod(F.xxhash64("name"), F.col("blocks")).alias("__block"))
    return leaders, members


def gate_phase_stream(changes: DataFrame, gates: DataFrame, delay: str = LATENESS) -> DataFrame:
    """ST7 with state: a row whenever a gate's phase changes, also at its deadline and without any change of a resource.

    ``changes`` has kind, ns, name, ts, seq and the status columns. Changes meet the conditions that name
    their resource in a stream-static join; only which conditions hold is kept, and changes of one instant are one.
    Gates of equal specs are followed as one, the leader of their kind, and its phases are given to all of them at the end.
    A gate that is not in ``gates`` has no phase.
    """
    use_rocksdb(changes.sparkSession)
    leaders, members = _kinds(gates)
    found = changes.withWatermark("ts", delay).select(
        F.col("kind").alias("type"), F.col("ns").alias("target_ns"), F.col("name").alias("condition"), "ts", "seq", "phase", "available", "succeeded")
    met = found.join(exploded_conditions(leaders), ["type", "target_ns", "condition"]).select(
        *KEY, "ts", micros("ts").alias("ts_us"), "seq", F.col("pos").cast("long").alias("pos"), condition_met().alias("met"))
    start = leaders.select(
        *KEY, F.size("conditions").cast("long").alias("conditions_total"), micros("created_at").alias("created_us"),
        micros(F.col("created_at") + F.col("timeout")).alias("deadline_us"), "blocks")
    processor = GateProcessor(held(delay))
    phases = met.groupBy(*KEY).transformWithState(
        statefulProcessor=processor, outputStructType=processor.output, outputMode="append", timeMode="EventTime",
        initialState=start.groupBy(*KEY))
    dealt = phases.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumnRenamed("name", "leading")
    same = (F.col("ns").eqNullSafe(F.col("__ns")) & F.col("leading").eqNullSafe(F.col("leader")) & (F.col("block") == F.col("__block")))
    every = dealt.join(members, same).select("ns", F.col("__name").alias("name"), "phase", "ts", "conditions_met", "conditions_total")
    return as_timestamps(every, ["ts"])


def gate_stream(changes: DataFrame, gates: DataFrame, as_of_column: str, path: str, checkpoint: str):
    """ST7: re-evaluate the gates that depend on a changed resource.

    Each micro-batch first merges its latest status rows into the versioned table under ``path``/resources,
    then evaluates only the gates that name one of them, as of the batch's newest change, and writes them
    to ``path``/gates under its own batch number, a plain partitioned table. A batch delivered again overwrites
    its own files, and what a batch reads does not grow with the number of batches.
    """
    resource = ["kind", "ns", "name"]

    def evaluate(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            _evaluate(spark, batch, batch_id)
        finally:
            batch.unpersist()

    def _evaluate(spark, batch: DataFrame, batch_id: int) -> None:
        known = StatusTable(spark, f"{path}/resources", resource, ["ts", "seq"])
        known.merge(batch, checkpoint, batch_id)
        newest = batch.agg(F.date_format(F.max(as_of_column), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t")).first().t
        if newest is None:
            return
        resources = known.read()
        changed = batch.select(F.col("kind").alias("type"), F.col("ns").alias("target_ns"), F.col("name").alias("condition"))
        named = exploded_conditions(gates).join(changed, ["type", "target_ns", "condition"], "left_semi")
        touched = gates.join(named.select(*KEY), KEY, "left_semi")
        status = gate_status(touched, gate_conditions(touched, resources), newest)
        status.withColumn("ts", F.lit(newest).cast("timestamp")).write.mode("overwrite").parquet(f"{path}/gates/batch_id={batch_id}")

    return (
        changes.writeStream.foreachBatch(evaluate).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())
