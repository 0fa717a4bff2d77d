"""The TPC-H-like test tables seen as coordination specs and logs.

Each function returns one canonical table. They are projections over a parquet scan, so
column pruning and filter pushdown reach the files. ``BASE`` holds the same tables as plain
SQL, for the independent checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from coordlytics.sources.specs import SPEC_SCHEMAS, read_events, read_specs, typed

ORDER_AS_OF = "1998-06-01 00:00:00"
EVENT_AS_OF = "2024-01-15 00:00:00"
EVENT_FILE = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


class Tables:
    """Canonical tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str, streaming: bool = False):
        self.spark, self.folder, self.streaming = spark, folder.rstrip("/"), streaming

    def as_streams(self) -> Tables:
        """The same tables, read as streams of files."""
        return Tables(self.spark, self.folder, streaming=True)

    def raw(self, table: str) -> DataFrame:
        path = f"{self.folder}/{table}.parquet"
        if not self.streaming:
            return self.spark.read.parquet(path)
        schema = self.spark.read.parquet(path).schema
        reader = self.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").option("maxFilesPerTrigger", 64)
        return reader.parquet(self.folder)

    def spec(self, table: str, kind: str, mapping: dict) -> DataFrame:
        mapping = {"ns": "'default'", **mapping}
        if self.streaming:
            return typed(self.raw(table), SPEC_SCHEMAS[kind], mapping)
        return read_specs(self.spark, f"{self.folder}/{table}.parquet", kind, mapping)

    def barriers(self) -> DataFrame:
        expected = "cast(1 + o_orderkey % 7 as int)"
        return self.spec("orders", "barrier", {
            "name": "o_orderkey",
            "created_at": "o_orderdate",
            "expected": expected,
            "quorum": f"case when o_orderkey % 3 = 0 then greatest(1, {expected} - 2) end",
            "timeout": "case when o_orderkey % 5 <> 0 then make_dt_interval(60) end",
        })

    def arrivals(self) -> DataFrame:
        return self.spec("lineitem", "arrival", {
            "barrier": "l_orderkey",
            "holder": "l_linenumber",
            "arrived_at": "l_shipdate",
            "seq": "l_linenumber",
            "labels": "map('barrier', cast(l_orderkey as string))",
        })

    def roster(self) -> DataFrame:
        return self.barriers().selectExpr(
            "ns", "name as barrier", "explode(transform(sequence(1, expected), k -> cast(k as string))) as holder")

    def semaphores(self) -> DataFrame:
        return self.spec("supplier", "semaphore", {
            "name": "s_suppkey", "permits": "5 + s_suppkey % 6"})

    def permits(self) -> DataFrame:
        """One permit per line, live from ship date until quantity days later."""
        return self.spec("lineitem", "permit", {
            "semaphore": "l_suppkey",
            "holder": "l_partkey % 20",
            "acquired_at": "l_shipdate",
            "expires_at": "l_shipdate + make_dt_interval(cast(l_quantity as int))",
            "seq": "l_orderkey * 10 + l_linenumber",
            "labels": "map('semaphore', cast(l_suppkey as string))",
        })

    def permit_events(self) -> DataFrame:
        """The same permits as a log: an acquire, and a release quantity days later."""
        rows = self.raw("lineitem").selectExpr(
            "l_suppkey", "l_partkey", "l_orderkey * 10 + l_linenumber as seq",
            "explode(array(struct('acquire' as op, l_shipdate as ts), struct('release' as op, "
            "l_shipdate + make_dt_interval(cast(l_quantity as int)) as ts))) as e")
        return rows.selectExpr(
            "'default' as ns", "cast(l_suppkey as string) as name", "e.op",
            "cast(l_partkey % 20 as string) as holder", "cast(e.ts as timestamp) as ts", "seq",
            "make_dt_interval(30) as ttl")

    def leases(self) -> DataFrame:
        return self.spec("nation", "lease", {"name": "n_nationkey", "ttl": "make_dt_interval(1)"})

    def lease_requests(self) -> DataFrame:
        rows = self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return rows.selectExpr(
            "'default' as ns", "cast(c_nationkey as string) as lease",
            "cast(o_custkey as string) as holder",
            "6 - cast(left(o_orderpriority, 1) as int) as priority",
            "cast(o_orderdate as timestamp) as requested_at", "o_orderkey as seq",
            "case when o_orderstatus = 'F' then 'Granted' end as phase",
            "map('lease', cast(c_nationkey as string)) as labels")

    def events(self, **columns: str) -> DataFrame:
        """The event log, keyed by user unless ``columns`` says otherwise."""
        mapping = {"ns": "'default'", "name": "user_id", "ts": "ts", "seq": "event_id", **columns}
        if self.streaming:
            return read_events(
                self.spark, self.folder, mapping, stream=True, source_schema=EVENT_FILE, file_glob="events.parquet")
        return read_events(self.spark, f"{self.folder}/events.parquet", mapping)

    def lease_log(self) -> DataFrame:
        """Clicks, views and signups ask for the user's lease, purchases clear it."""
        return self.events(
            kind="'lease'", holder="event_type", priority="event_id % 4",
            op="case when event_type = 'purchase' then 'clear' else 'request' end",
            ttl="make_dt_interval(0, 6)")

    def lease_status_log(self) -> DataFrame:
        """The recorded holder of the user's lease after each event; a purchase leaves none."""
        return self.events(
            kind="'lease'", holder="nullif(event_type, 'purchase')", op="'status'", ttl="make_dt_interval(0, 6)").withColumn(
            "expires_at", F.col("ts") + F.col("ttl"))

    def heartbeats(self) -> DataFrame:
        return self.events(kind="'lease'", holder="event_type", op="'renew'", ttl="make_dt_interval(0, 6)")

    def barrier_log(self) -> DataFrame:
        """Barriers being created and holders arriving, in one log."""
        created = self.barriers().selectExpr(
            "ns", "name", "'create' as op", "cast(null as string) as holder", "created_at as ts", "0L as seq",
            "coalesce(quorum, expected) as required", "created_at + timeout as deadline")
        arrived = self.arrivals().selectExpr(
            "ns", "barrier as name", "'arrive' as op", "holder", "arrived_at as ts", "seq",
            "cast(null as int) as required", "cast(null as timestamp) as deadline")
        return created.unionByName(arrived)

    def runs(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "'default' as ns", "cast(user_id as string) as name", "event_type as holder",
            "cast(ts as timestamp) as start_at",
            "cast(ts as timestamp) + make_dt_interval(0, 0, cast(round(value * 10) as int)) as end_at",
            "event_id as seq")

    def mutex_ops(self) -> DataFrame:
        return self.events(
            kind="'mutex'", holder="concat('h', event_id % 3)",
            op="case event_type when 'click' then 'lock' when 'purchase' then 'unlock' end",
            ttl="make_dt_interval(0, 12)").filter("op is not null")

    def rwmutex_ops(self) -> DataFrame:
        return self.events(
            kind="'rwmutex'", holder="concat('h', event_id % 3)",
            op="case event_type when 'view' then 'rlock' when 'click' then 'lock' "
            "when 'purchase' then 'unlock' end",
            ttl="make_dt_interval(0, 12)").filter("op is not null")

    def lock_requests(self) -> DataFrame:
        """Views ask for the user's lock, clicks obtain it."""
        return self.events(
            kind="'mutex'", holder="concat('h', event_id % 3)",
            op="case event_type when 'view' then 'request' when 'click' then 'acquire' end",
        ).filter("op is not null")

    def onces(self) -> DataFrame:
        """One per user and day with any event; it lives for seven days."""
        return self.raw("events").selectExpr(
            "'default' as ns", "concat(user_id, '/', date(ts)) as name",
            "cast(date(ts) as timestamp) as created_at", "make_dt_interval(7) as ttl").distinct()

    def claims(self) -> DataFrame:
        return self.raw("events").filter("event_type = 'signup'").selectExpr(
            "'default' as ns", "concat(user_id, '/', date(ts)) as name",
            "concat('h', event_id % 3) as executor", "cast(ts as timestamp) as ts",
            "event_id as seq", "value >= 20 as ok")

    def waitgroups(self) -> DataFrame:
        return self.spec("customer", "waitgroup", {"name": "c_custkey"})

    def deltas(self) -> DataFrame:
        return self.events(
            kind="'waitgroup'", op="case when event_type in ('purchase', 'error') then 'done' else 'add' end",
            delta="case event_type when 'signup' then 2 when 'purchase' then -1 when 'error' then -2 else 1 end")

    def jobs(self) -> DataFrame:
        return self.spec("orders", "job", {
            "name": "o_orderkey", "succeeded": "if(o_orderstatus = 'F', 1, 0)"})

    def gates(self) -> DataFrame:
        """One per customer: all its orders, its nation, a supplier, its last order."""
        orders = self.raw("orders").selectExpr("o_custkey", "o_orderkey")
        own = orders.groupBy("o_custkey").agg(
            F.sort_array(F.collect_list("o_orderkey")).alias("early"), F.max("o_orderkey").alias("latest"))
        suppliers = self.raw("supplier").agg(F.count(F.lit(1))).scalar()
        empty = "cast(null as int)"

        def one(type_, name, state, value=empty):
            return (f"named_struct('type', '{type_}', 'name', cast({name} as string), "
                    f"'namespace', '', 'state', '{state}', 'value', {value})")

        return (
            self.raw("customer").join(own, F.col("o_custkey") == F.col("c_custkey"), "left").withColumn("suppliers", suppliers)
            .selectExpr(
                "'default' as ns", "cast(c_custkey as string) as name",
                "timestamp '1998-01-01 00:00:00' as created_at",
                "case when c_custkey % 4 <> 0 then make_dt_interval(cast(c_custkey % 300 as int)) end as timeout",
                f"""concat(
                  transform(coalesce(early, array()), k -> {one('Barrier', 'k', 'Open')}),
                  array({one('Lease', 'c_nationkey', 'Available')},
                        {one('Semaphore', 'c_custkey % suppliers', '', '2')}),
                  if(latest is null, array(), array({one('Job', 'latest', 'Complete')}))) as conditions"""))

    def nested_gates(self) -> DataFrame:
        """Gate k waits for gate k/2; the nations of one residue modulo five form a cycle."""
        tree = self.raw("customer").filter("c_custkey > 1").selectExpr(
            "'default' as ns", "cast(c_custkey as string) as name",
            "cast(cast(floor(c_custkey / 2) as bigint) as string) as depends_on")
        cycle = self.raw("nation").selectExpr(
            "'default' as ns", "concat('n', n_nationkey) as name",
            "concat('n', (n_nationkey + 5) % 25) as depends_on")
        return tree.unionByName(cycle)


# The same bindings as plain SQL. Fixed text, one CTE per canonical table.
BASE: dict[str, str] = {
    "barriers": """
      select o_orderkey::varchar as name, o_orderdate as created_at,
        (1 + o_orderkey % 7)::int as expected,
        case when o_orderkey % 3 = 0 then greatest(1, 1 + o_orderkey % 7 - 2) end::int as quorum,
        case when o_orderkey % 5 <> 0 then o_orderdate + interval 60 day end as deadline
      from orders""",
    "arrivals": """
      select l_orderkey::varchar as barrier, l_linenumber::varchar as holder,
        min(l_shipdate) as arrived_at, l_linenumber::bigint as seq
      from lineitem group by l_orderkey, l_linenumber""",
    "ranked_arrivals": """
      select *, row_number() over (partition by barrier order by arrived_at, seq) as pos from arrivals""",
    "opened": """
      select b.name, b.created_at, b.expected, b.quorum, b.deadline, coalesce(b.quorum, b.expected) as required,
        case when a.arrived_at is not null and (b.deadline is null or a.arrived_at <= b.deadline)
          then greatest(a.arrived_at, b.created_at) end as opened_at
      from barriers b left join ranked_arrivals a
        on a.barrier = b.name and a.pos = coalesce(b.quorum, b.expected)""",
    "semaphores": """
      select s_suppkey::varchar as name, (5 + s_suppkey % 6)::int as permits from supplier""",
    "permits": """
      select l_suppkey::varchar as semaphore, (l_partkey % 20)::varchar as holder, l_shipdate as acquired_at,
        l_shipdate + l_quantity::int * interval 1 day as expires_at, l_orderkey * 10 + l_linenumber as seq
      from lineitem""",
    "permit_events": """
      select semaphore as name, holder, 'acquire' as op, acquired_at as ts, 1 as d from permits
      union all select semaphore, holder, 'release', expires_at, -1 from permits""",
    "leases": "select n_nationkey::varchar as name from nation",
    "lease_requests": """
      select c_nationkey::varchar as lease, o_custkey::varchar as holder,
        6 - left(o_orderpriority, 1)::int as priority, o_orderdate as requested_at, o_orderkey as seq,
        case when o_orderstatus = 'F' then 'Granted' end as phase
      from orders join customer on o_custkey = c_custkey""",
    "lease_log": """
      select user_id::varchar as name, event_type as holder, (event_id % 4)::int as priority, ts, event_id as seq,
        case when event_type = 'purchase' then 'clear' else 'request' end as op from events""",
    "heartbeats": "select user_id::varchar as name, event_type as holder, ts, event_id as seq from events",
    "runs": """
      select user_id::varchar as name, event_type as holder, ts as start_at,
        ts + round(value * 10)::int * interval 1 minute as end_at, event_id as seq from events""",
    "mutex_ops": """
      select user_id::varchar as name, 'h' || (event_id % 3) as holder, ts, event_id as seq,
        case event_type when 'click' then 'lock' else 'unlock' end as op
      from events where event_type in ('click', 'purchase')""",
    "rwmutex_ops": """
      select user_id::varchar as name, 'h' || (event_id % 3) as holder, ts, event_id as seq,
        case event_type when 'view' then 'rlock' when 'click' then 'lock' else 'unlock' end as op
      from events where event_type in ('view', 'click', 'purchase')""",
    "lock_requests": """
      select user_id::varchar as name, 'h' || (event_id % 3) as holder, ts, event_id as seq,
        case event_type when 'view' then 'request' else 'acquire' end as op
      from events where event_type in ('view', 'click')""",
    "onces": """
      select distinct user_id || '/' || strftime(ts, '%Y-%m-%d') as name, date_trunc('day', ts)::timestamp as created_at
      from events""",
    "claims": """
      select user_id || '/' || strftime(ts, '%Y-%m-%d') as name, 'h' || (event_id % 3) as executor, ts,
        event_id as seq, value >= 20 as ok
      from events where event_type = 'signup'""",
    "deltas": """
      select user_id::varchar as name, ts, event_id as seq,
        case event_type when 'signup' then 2 when 'purchase' then -1 when 'error' then -2 else 1 end as delta
      from events""",
    "conditions": """
      with ranked as (
        select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as pos
        from orders)
      select o_custkey::varchar as gate, pos - 1 as pos, 'Barrier' as type, o_orderkey::varchar as cname,
        'Open' as state, null::int as value from ranked
      union all
      select c_custkey::varchar, 1000001, 'Lease', c_nationkey::varchar, 'Available', null from customer
      union all
      select c_custkey::varchar, 1000002, 'Semaphore', (c_custkey % (select count(*) from supplier))::varchar, '', 2 from customer
      union all
      select o_custkey::varchar, 1000003, 'Job', max(o_orderkey)::varchar, 'Complete', null from orders
      where o_custkey in (select c_custkey from customer) group by o_custkey""",
    "gates": """
      select c_custkey::varchar as name,
        case when c_custkey % 4 <> 0 then timestamp '1998-01-01' + (c_custkey % 300)::int * interval 1 day end as deadline
      from customer""",
    "nested_gates": """
      select c_custkey::varchar as name, (c_custkey // 2)::varchar as depends_on from customer where c_custkey > 1
      union all select 'n' || n_nationkey, 'n' || ((n_nationkey + 5) % 25) from nation""",
    "jobs": "select o_orderkey::varchar as name, case when o_orderstatus = 'F' then 1 else 0 end as succeeded from orders",
}
