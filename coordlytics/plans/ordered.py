"""Per-key ordered computation, by one plan whatever the number of rows of a key.

Every running value is a two-level prefix. The rows of a key are cut into buckets that follow the order
(hours of its leading instant); totals per (key, bucket) are summed map-side where rows are
in place, a window over the totals gives what the earlier buckets contribute, and a window
inside the bucket does the rest. No task ever orders a whole key, nothing is counted first and
no job runs while a plan is built. Rows are shuffled once by (key, bucket); the totals, the
windows and further scans of the same order share that shuffle.

Folds, whose next state depends on the last one, stream through Arrow batches by key.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

BUCKET, GROUP, ROW = "__bucket", "__group", "__row"
#: Columns that keep rows in their buckets for further scans.
HELD = [GROUP, BUCKET]
#: Length of a bucket: of instants, and of whole numbers that lead an order.
BUCKET_UNIT, BUCKET_SPAN = "hour", 4096


@dataclass(frozen=True)
class Prefix:
    """One running value over the rows of a key.

    ``how`` is sum, min, max, last (last non-null) or prev (the row before, null kept).
    ``reverse`` runs from the end of the key, which turns prev into "next row" and last into
    "next non-null". ``inclusive`` says whether the current row counts.
    """

    how: str
    expr: Column
    inclusive: bool = True
    reverse: bool = False


def bucketed(df: DataFrame, keys: list[str], order: list[str], bucket: Column | None = None) -> DataFrame:
    """Rows of a (key, bucket) together. The bucket is a coarser form of the leading order column.

    Rows are shuffled as one struct, under a key and a bucket that are never null: whatever columns or null
    checks the plans above need, they all ask for the very same shuffle, which then happens once.
    """
    if BUCKET in df.columns:
        return df
    if bucket is None:
        lead, kind = F.col(order[0]), df.schema[order[0]].dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            bucket = F.date_trunc(BUCKET_UNIT, lead)
        elif isinstance(kind, T.IntegralType):
            bucket = F.floor(lead / BUCKET_SPAN)
        else:
            raise TypeError(f"no buckets for an order led by {kind.simpleString()}")
    never = F.lit("1900-01-01").cast("timestamp") if isinstance(df.schema[order[0]].dataType, T.TimestampType) else None
    filled = bucket if never is None else F.coalesce(bucket, never.cast(df.select(bucket.alias("b")).schema["b"].dataType))
    packed = df.select(F.struct(*keys).alias(GROUP), filled.alias(BUCKET), F.struct(*df.columns).alias(ROW))
    return packed.repartition(GROUP, BUCKET).select(*HELD, f"{ROW}.*")


# ---------------------------------------------------------------- keys of few and of many rows

#: Keys are counted together by so many hashes; a key is busy if the rows of its hash are more than these, and more than
#: eight times their mean.
CELLS, FEW_ROWS = 1 << 14, 100_000


def busy_keys(*logs: tuple[DataFrame, list[str]], weight: str | None = None) -> Callable[[list[str]], Column]:
    """Whether the key in some columns may have many rows in the logs, given with their key columns. ``weight``: a
    column that says for how many rows a row stands.

    Busy keys are computed by (key, bucket), which shuffles their rows several times and has no task order a whole
    key; the rows of all others are shuffled once, by key. The counts are exact, at most CELLS rows a task, and part of the plan: a
    scalar subquery. Both ways give the same, so it does not matter that a hash may make a small key busy.
    """
    def cell(keys):
        return F.pmod(F.xxhash64(*keys), F.lit(CELLS))

    cells = reduce(DataFrame.unionByName, [
        df.select(cell(keys).alias("cell"), (F.col(weight) if weight else F.lit(1).cast("long")).alias("n")) for df, keys in logs])
    counts = cells.groupBy("cell").agg(F.sum("n").alias("n"))
    every = counts.agg(F.collect_list(F.struct("cell", "n")).alias("cells"), F.sum("n").alias("total"))
    most = F.greatest(F.lit(FEW_ROWS), F.col("total") * 8 / CELLS)
    busy = every.select(F.transform(F.filter("cells", lambda c: c["n"] > most), lambda c: c["cell"])).scalar()
    return lambda keys: F.array_contains(busy, cell(keys))


def split_scan(df: DataFrame, keys: list[str], order: list[str], specs: dict[str, Prefix], busy: Column) -> DataFrame:
    """`ordered_scan` for the rows of busy keys, and one window over the key for all others."""
    few = df.filter(~busy)
    wrapped = {c: _keep_null_rows(s) for c, s in specs.items()}
    values = {c: _running(s, keys, order) for c, s in wrapped.items()}
    whole = few.select("*", *[(v["v"] if specs[c].how == "prev" else v).alias(c) for c, v in values.items()])
    return whole.unionByName(ordered_scan(df.filter(busy), keys, order, specs))


# ---------------------------------------------------------------- running values


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    specs: dict[str, Prefix],
    bucket: Column | None = None,
    more: bool = False,
) -> DataFrame:
    """``df`` with one running column per entry of ``specs``.

    ``more`` keeps the rows in their buckets for another scan with the same keys and order.
    """
    rows = bucketed(df, keys, order, bucket)
    specs = {c: _keep_null_rows(s) for c, s in specs.items()}
    local = rows.select(
        "*", *[_running(s, HELD, order).alias(f"__l_{c}") for c, s in specs.items()])
    totals = rows.groupBy(*HELD).agg(
        *[_bucket_total(s, order).alias(f"__t_{c}") for c, s in specs.items()])
    carried = local.join(_carries(totals, specs), HELD, "left")
    return carried.select(
        *[c for c in rows.columns if more or c not in HELD],
        *[_combine(s, f"__l_{c}", f"__c_{c}").alias(c) for c, s in specs.items()])


def composed_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    local: list[dict[str, Callable]],
    totals: dict[str, Column],
    carries: list[dict[str, Callable]],
    bucket: Column | None = None,
) -> DataFrame:
    """``df`` with running values that depend on each other, by one summary per (key, bucket).

    ``local`` are values inside a bucket, functions of the window over its rows in order. ``totals`` describe the bucket,
    aggregates over rows with their local values. ``carries`` are what other buckets mean for it, functions of
    the windows over the earlier and the later buckets of the key. Each entry of a list may use the columns of the
    entries before it, so any number of dependent values takes one exchange of summaries and one join.
    The rows stay in their buckets, with the local and carried columns.
    """
    rows = bucketed(df, keys, order, bucket)
    inside = _window(HELD, order, False)
    for step in local:
        rows = rows.withColumns({c: f(inside) for c, f in step.items()})
    summary = rows.groupBy(*HELD).agg(*[v.alias(c) for c, v in totals.items()])
    earlier = _window([GROUP], [BUCKET], False).rowsBetween(W.unboundedPreceding, -1)
    later = _window([GROUP], [BUCKET], True).rowsBetween(W.unboundedPreceding, -1)
    for step in carries:
        summary = summary.withColumns({c: f(earlier, later) for c, f in step.items()})
    return rows.join(summary.select(*HELD, *[c for step in carries for c in step]), HELD, "left")


def inside_bucket(order: list[str]):
    """The window over the rows of a (key, bucket) in order, for rows that are held in their buckets."""
    return _window(HELD, order, False)


def _window(keys: list[str], order: list[str], reverse: bool):
    cols = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    return W.partitionBy(*keys).orderBy(*cols)


def _running(spec: Prefix, keys: list[str], order: list[str]) -> Column:
    w = _window(keys, order, spec.reverse)
    if spec.how == "prev":
        return F.lag(spec.expr).over(w)
    frame = w.rowsBetween(W.unboundedPreceding, 0 if spec.inclusive else -1)
    return _aggregate(spec.how)(spec.expr).over(frame)


def _aggregate(how: str) -> Callable[[Column], Column]:
    return {
        "sum": F.sum,
        "min": F.min,
        "max": F.max,
        "last": lambda c: F.last(c, ignorenulls=True),
    }[how]


def _keep_null_rows(spec: Prefix) -> Prefix:
    """Wrap prev values, so that a null value differs from having no row before."""
    if spec.how != "prev":
        return spec
    return Prefix("prev", F.struct(spec.expr.alias("v")), spec.inclusive, spec.reverse)


def _bucket_total(spec: Prefix, order: list[str]) -> Column:
    if spec.how in ("sum", "min", "max"):
        return _aggregate(spec.how)(spec.expr)
    pick = F.min_by if spec.reverse else F.max_by
    position = F.struct(*order)
    if spec.how == "last":
        # a null position is skipped, so only rows with a value compete
        return pick(spec.expr, F.when(spec.expr.isNotNull(), position))
    return pick(spec.expr, position)


def _carries(totals: DataFrame, specs: dict[str, Prefix]) -> DataFrame:
    """What the other buckets of the same key contribute to a bucket."""
    carried = []
    for c, s in specs.items():
        total = F.col(f"__t_{c}")
        before = _window([GROUP], [BUCKET], s.reverse)
        if s.how == "prev":
            value = F.lag(total).over(before)
        else:
            value = _aggregate(s.how)(total).over(before.rowsBetween(W.unboundedPreceding, -1))
        carried.append(value.alias(f"__c_{c}"))
    return totals.select(*HELD, *carried)


def _combine(spec: Prefix, local: str, carry: str) -> Column:
    here, before = F.col(local), F.col(carry)
    if spec.how == "sum":
        return F.when(here.isNull(), before).when(before.isNull(), here).otherwise(here + before)
    if spec.how == "min":
        return F.least(here, before)
    if spec.how == "max":
        return F.greatest(here, before)
    if spec.how == "last":
        return F.coalesce(here, before)
    # prev: the first row of a bucket has no row before it inside the bucket
    return F.coalesce(here, before)["v"]


def running_balance(df: DataFrame, keys: list[str], order: list[str], delta: Column, more: bool = False) -> DataFrame:
    """Prefix sum of ``delta`` and the minimum of that prefix sum, in one pass.

    Adds total, floor (lowest total so far), floor_before (the same without the current row)
    and ups (positive steps so far). ``total - least(0, floor)`` is the sum clamped at zero on
    every step. Buckets compose: one is described by its sum, its lowest prefix relative to
    its start and its positive steps.
    """
    step = bucketed(df, keys, order).withColumn("__d", delta.cast("long"))
    rows = _window(HELD, order, False)
    upto, earlier = rows.rowsBetween(W.unboundedPreceding, 0), rows.rowsBetween(W.unboundedPreceding, -1)
    up = F.when(F.col("__d") > 0, 1).otherwise(0)
    local = (
        step.withColumns({"total": F.sum("__d").over(upto), "ups": F.sum(up).over(upto)})
        .withColumns({"floor": F.min("total").over(upto), "floor_before": F.min("total").over(earlier)}))
    totals = local.groupBy(*HELD).agg(
        F.sum("__d").alias("__s"), F.min("floor").alias("__m"), F.max("ups").alias("__u"))
    before = _window([GROUP], [BUCKET], False).rowsBetween(W.unboundedPreceding, -1)
    carries = (
        totals.withColumn("__cs", F.coalesce(F.sum("__s").over(before), F.lit(0)))
        .withColumn("__cm", F.min(F.col("__cs") + F.col("__m")).over(before))
        .withColumn("__cu", F.coalesce(F.sum("__u").over(before), F.lit(0)))
        .select(*HELD, "__cs", "__cm", "__cu"))
    joined = local.join(carries, HELD, "left")
    start = F.coalesce("__cs", F.lit(0))
    return joined.select(
        *[c for c in step.columns if c != "__d" and (more or c not in HELD)],
        (F.col("total") + start).alias("total"),
        (F.col("ups") + F.coalesce("__cu", F.lit(0))).alias("ups"),
        F.least(F.col("floor") + start, "__cm").alias("floor"),
        F.least(F.col("floor_before") + start, "__cm").alias("floor_before"),
    )


# ---------------------------------------------------------------- folds


class Fold:
    """A small per-key state machine. State must be picklable and stay small.

    ``inputs`` names the columns handed to ``step`` in order; ``output`` is the schema of the
    emitted tuples, to which the key columns are prepended.
    """

    inputs: list[str]
    output: T.StructType

    def start(self):
        raise NotImplementedError

    def step(self, state, row, emit):
        """Next state after ``row``; call ``emit(tuple)`` for every output row."""
        raise NotImplementedError

    #: Optional column with the instant, the same for all rows of a stretch, at which the stretch ends.
    ends: str | None = None

    def finish(self, state, emit, end):
        """Called once after the last row of a key; ``end`` is the value of the ``ends`` column."""


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], fold: Fold) -> DataFrame:
    """Run ``fold`` over the rows of every key in order, each row once.

    Rows stream through Arrow batches sorted by key, so memory holds one batch and one state
    whatever the key size. A key is one stream: callers cut long logs into stretches first where
    the state is known to be empty, and make the stretch part of the key.
    """
    key_fields = [df.schema[k] for k in keys]
    schema = T.StructType([*key_fields, *fold.output.fields])
    ends = [fold.ends] if fold.ends else []
    columns = [*keys, *fold.inputs, *ends]
    rows = df.select(*dict.fromkeys([*columns, *order])).repartition(*keys)
    ordered = rows.sortWithinPartitions(*dict.fromkeys([*keys, *order])).select(*columns)
    return ordered.mapInArrow(_runner(fold, len(keys), schema), schema)


class ComposedFold(Fold):
    """A fold whose effect on any entering state can be told from a summary of the rows."""

    def summary(self, rows: list[tuple]):
        """What the rows, in order, do to any state."""
        raise NotImplementedError

    def through(self, summary, state):
        """The state behind the rows, entered with ``state``."""
        raise NotImplementedError


def composed_fold(df: DataFrame, keys: list[str], order: list[str], fold: ComposedFold, only_last: bool = False) -> DataFrame:
    """Run ``fold`` over every key's rows in order, bucket by bucket, by one plan whatever the number of rows of a key.

    Each (key, bucket) is summarised as a function from the entering state to the leaving one; these
    are composed along the key, one small row per bucket; then every bucket is replayed from the state it is entered with. The rows of
    a key are spread over all tasks in both passes and shuffled once. ``only_last`` replays the last bucket of each key.
    """
    columns = [*keys, *fold.inputs]
    rows = bucketed(df.select(*dict.fromkeys([*columns, *order])), keys, order)
    sorting = dict.fromkeys([*HELD, *order])
    bucket = rows.schema[BUCKET]
    key_fields = [df.schema[k] for k in keys]
    binary = T.StructField("__effect", T.BinaryType())
    effects = T.StructType([*key_fields, bucket, binary])
    summaries = rows.sortWithinPartitions(*sorting).select(*keys, BUCKET, *fold.inputs).mapInArrow(
        _summariser(fold, len(keys) + 1, effects), effects)
    entered = T.StructType([*key_fields, bucket, T.StructField("__enter", T.BinaryType()), T.StructField("__last", T.BooleanType())])
    entries = summaries.repartition(*keys).sortWithinPartitions(*keys, BUCKET).mapInArrow(
        _composer(fold, len(keys), entered), entered).select(F.struct(*keys).alias(GROUP), BUCKET, "__enter", "__last")
    if only_last:
        entries = entries.filter("__last")
    output = T.StructType([*key_fields, *fold.output.fields])
    return rows.join(entries, HELD).sortWithinPartitions(*sorting).select(*keys, BUCKET, *fold.inputs, "__enter", "__last").mapInArrow(
        _replayer(fold, len(keys) + 1, output), output)


def _record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _summariser(fold: ComposedFold, n_keys: int, schema: T.StructType):
    arrow_schema = to_arrow_schema(schema)

    def run(batches):
        key, held, done = None, [], []
        for row_key, _, rows in _stretches(batches, n_keys, len(fold.inputs)):
            if row_key != key:
                if key is not None:
                    done.append((*key, pickle.dumps(fold.summary(held))))
                key, held = row_key, []
            held.extend(rows)
            if len(done) >= 1_000:
                yield _record_batch(done, arrow_schema)
                done = []
        if key is not None:
            done.append((*key, pickle.dumps(fold.summary(held))))
        if done:
            yield _record_batch(done, arrow_schema)

    return run


def _composer(fold: ComposedFold, n_keys: int, schema: T.StructType):
    arrow_schema = to_arrow_schema(schema)

    def run(batches):
        key, state, waiting, done = None, None, None, []
        for batch in batches:
            for *own, bucket, effect in zip(*[c.to_pylist() for c in batch.columns]):
                if waiting is not None:
                    done.append((*waiting, own != key))
                if own != key:
                    key, state = own, fold.start()
                waiting = (*own, bucket, pickle.dumps(state))
                state = fold.through(pickle.loads(effect), state)
            if len(done) >= 1_000:
                yield _record_batch(done, arrow_schema)
                done = []
        if waiting is not None:
            done.append((*waiting, True))
        if done:
            yield _record_batch(done, arrow_schema)

    return run


def _replayer(fold: ComposedFold, n_keys: int, schema: T.StructType):
    arrow_schema = to_arrow_schema(schema)

    def run(batches):
        out: list[tuple] = []
        done: list[tuple] = []
        key, state, last = None, None, False

        def keep():
            done.extend((*key[:-1], *values) for values in out)
            out.clear()

        for row_key, _, rows in _stretches(batches, n_keys, len(fold.inputs) + 2):
            if row_key != key:
                if key is not None and last:
                    fold.finish(state, out.append, None)
                    keep()
                key, last = row_key, rows[0][-1]
                state = pickle.loads(rows[0][-2])
            for row in rows:
                state = fold.step(state, row[:-2], out.append)
            keep()
            if len(done) >= 10_000:
                yield _record_batch(done, arrow_schema)
                done = []
        if key is not None and last:
            fold.finish(state, out.append, None)
            keep()
        if done:
            yield _record_batch(done, arrow_schema)

    return run


def _plain_values(column: pa.Array) -> list:
    """A column as Python values, by the cheapest route its type allows."""
    if column.null_count:
        return column.to_pylist()
    if pa.types.is_integer(column.type):
        return column.to_numpy().tolist()
    if pa.types.is_string(column.type):
        coded = column.dictionary_encode()
        words = coded.dictionary.to_pylist()
        return [words[i] for i in coded.indices.to_numpy().tolist()]
    return column.to_pylist()


def _stretches(batches: Iterable[pa.RecordBatch], n_keys: int, n_inputs: int) -> Iterator[tuple]:
    """(key, end, rows) for every run of one key inside a batch; end is None when there is no such column.

    Keys are compared as whole columns, so the loop over rows only touches the fold's inputs.
    """
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        changes = np.zeros(n - 1, dtype=bool)
        for column in batch.columns[:n_keys]:
            differs = pc.not_equal(column.slice(1), column.slice(0, n - 1))
            changes |= pc.fill_null(differs, True).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), n]
        rows = list(zip(*[_plain_values(c) for c in batch.columns[n_keys : n_keys + n_inputs]]))
        ends = batch.column(n_keys + n_inputs) if batch.num_columns > n_keys + n_inputs else None
        for low, high in zip(cuts, cuts[1:]):
            key = tuple(c[low].as_py() for c in batch.columns[:n_keys])
            yield key, None if ends is None else ends[low].as_py(), rows[low:high]


def _runner(fold, n_keys, schema):
    arrow_schema = to_arrow_schema(schema)

    def run(batches):
        out: list[tuple] = []
        emit, step = out.append, fold.step
        keys: list[tuple] = []
        key, state, end = None, None, None

        def keep_keys():
            keys.extend([key] * (len(out) - len(keys)))

        def flush():
            columns = [*zip(*keys), *zip(*out)]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow_schema)]
            keys.clear()
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=arrow_schema)

        for row_key, row_end, rows in _stretches(batches, n_keys, len(fold.inputs)):
            if row_key != key:
                if key is not None:
                    fold.finish(state, emit, end)
                    keep_keys()
                key, state, end = row_key, fold.start(), row_end
            for row in rows:
                state = step(state, row, emit)
            keep_keys()
            if len(out) >= 10_000:
                yield flush()
        if key is not None:
            fold.finish(state, emit, end)
            keep_keys()
        if out:
            yield flush()

    return run
