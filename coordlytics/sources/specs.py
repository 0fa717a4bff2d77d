"""IO1, IO2: typed readers, and the layout of a log that selections can be pushed into.

The kinds' own schemas are explicit; files of another layout that are read through a mapping have the schema
given with it, else the one they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_KEY = "ns string, name string, created_at timestamp, labels map<string,string>"
_TTL = "ttl interval day to second"
_CONDITION = "struct<type:string,name:string,namespace:string,state:string,value:int>"

SPEC_SCHEMAS: dict[str, str] = {
    "barrier": f"{_KEY}, expected int, quorum int, timeout interval day to second",
    "semaphore": f"{_KEY}, permits int, {_TTL}",
    "lease": f"{_KEY}, priority int, {_TTL}, holder string, acquired_at timestamp, expires_at timestamp",
    "mutex": f"{_KEY}, {_TTL}",
    "rwmutex": f"{_KEY}, {_TTL}",
    "once": f"{_KEY}, {_TTL}",
    "waitgroup": f"{_KEY}, {_TTL}",
    "gate": f"{_KEY}, timeout interval day to second, conditions array<{_CONDITION}>",
    "job": f"{_KEY}, succeeded int",
    "arrival": "ns string, barrier string, holder string, arrived_at timestamp, seq long, labels map<string,string>",
    "permit": "ns string, semaphore string, holder string, acquired_at timestamp, "
    "expires_at timestamp, seq long, phase string, labels map<string,string>, " + _TTL,
    "lease_request": "ns string, lease string, holder string, priority int, requested_at timestamp, "
    "seq long, phase string, labels map<string,string>, " + _TTL,
}

EVENT_SCHEMA = (
    "ns string, kind string, name string, op string, holder string, ts timestamp, seq long, "
    "delta int, ok boolean, priority int, ttl interval day to second, labels map<string,string>"
)


def typed(df: DataFrame, schema: str, mapping: dict[str, str | Column]) -> DataFrame:
    """Project ``df`` to ``schema``; columns without a mapping are null of the right type."""
    columns = []
    for f in T.StructType.fromDDL(schema).fields:
        source = mapping.get(f.name, F.lit(None))
        value = F.expr(source) if isinstance(source, str) else source
        columns.append(value.cast(f.dataType).alias(f.name))
    return df.select(*columns)


def read_specs(
    spark: SparkSession,
    path: str,
    kind: str,
    mapping: dict[str, str | Column] | None = None,
    fmt: str | None = None,
    source_schema: str | None = None,
) -> DataFrame:
    """IO1: the spec table of a kind.

    ``source_schema`` is the schema of files of another layout; without it that of the files is taken.

    ``mapping`` gives an expression per spec column when the files have another layout, in
    which case only the named columns are scanned. JSON input keeps its text in ``raw`` so that
    validation can report fields the schema does not know.
    """
    schema = SPEC_SCHEMAS[kind]
    fmt = fmt or ("json" if path.rstrip("/").endswith(".json") else "parquet")
    if fmt == "json":
        # interval columns arrive as duration text, so they stay text until parse_durations
        text_schema = schema.replace("interval day to second", "string")
        lines = spark.read.text(path).withColumnRenamed("value", "raw")
        return lines.select(F.from_json("raw", text_schema).alias("s"), "raw").select("s.*", "raw")
    if mapping is None:
        return spark.read.schema(schema).format(fmt).load(path)
    reader = spark.read.schema(source_schema) if source_schema else spark.read
    return typed(reader.format(fmt).load(path), schema, mapping)


def read_events(
    spark: SparkSession,
    path: str,
    mapping: dict[str, str | Column] | None = None,
    stream: bool = False,
    source_schema: str | None = None,
    files_per_trigger: int = 64,
    file_glob: str | None = None,
    since: str | None = None,
    until: str | None = None,
) -> DataFrame:
    """IO2: the append-only coordination log, as a batch or as a stream of new files.

    A stream takes ``files_per_trigger`` files at a time, which also bounds the rows of one key
    that a stateful operator sees at once, however many have piled up. ``since`` (inclusive) and ``until``
    (exclusive) bound ``ts``; a log partitioned by a ``date`` column is read only in the folders of those days.
    """
    reader = spark.readStream if stream else spark.read
    if source_schema or mapping is None:
        reader = reader.schema(source_schema or EVENT_SCHEMA)
    if stream:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    rows = reader.parquet(path)
    ts = F.col("ts") if mapping is None else F.expr(mapping["ts"]) if isinstance(mapping["ts"], str) else mapping["ts"]
    for bound, holds in ((since, lambda c, b: c >= b), (until, lambda c, b: c < b)):
        if bound is not None:
            rows = rows.filter(holds(ts, F.lit(bound).cast("timestamp")))
            if "date" in rows.columns:
                day = F.lit(bound).cast("date")
                rows = rows.filter(F.col("date") >= day if bound == since else F.col("date") <= day)
    return rows if mapping is None else typed(rows, EVENT_SCHEMA, mapping)


#: Columns that hold one label each in a clustered table.
LABEL = "label_"


def write_clustered(df: DataFrame, path: str, labels: list[str], time: str = "ts", unit: str = "day", mode: str = "append") -> None:
    """A log or table of children laid out for what is asked of it.

    One folder per day, month or year (``unit``) of ``time``, named by its first day (column ``date``), rows of a folder dealt and ordered by (ns, name) or whatever leads
    ``df`` after ns, so that the files' statistics skip other keys, and each of ``labels`` as a column of its own besides the map, which no
    filter can be pushed into. Rows are dealt by ranges, so a key or a day of any share is spread over files.
    """
    key = [c for c in df.columns if c == "ns"] + [c for c in df.columns if c not in ("ns", "labels", time)][:1]
    promoted = df.withColumns({f"{LABEL}{name}": F.col("labels")[name] for name in labels}).withColumn("date", F.to_date(F.date_trunc(unit, time)))
    order = ["date", *key, time]
    promoted.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("date").mode(mode).parquet(path)


def read_clustered(spark: SparkSession, path: str, schema: str, labels: list[str], since: str | None = None, until: str | None = None,
                   time: str = "ts", unit: str = "day") -> DataFrame:
    """What `write_clustered` wrote: ``schema`` with the promoted labels and the date; bounds read only their days and row groups."""
    columns = ", ".join(f"{LABEL}{name} string" for name in labels)
    rows = spark.read.schema(f"{schema}, {columns}, date date" if labels else f"{schema}, date date").parquet(path)
    for bound, late in ((since, False), (until, True)):
        if bound is not None:
            moment = F.lit(bound).cast("timestamp")
            day = F.to_date(F.date_trunc(unit, moment))
            rows = rows.filter(F.col(time) < moment if late else F.col(time) >= moment)
            rows = rows.filter(F.col("date") <= day if late else F.col("date") >= day)
    return rows
