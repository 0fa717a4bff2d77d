"""Small tables for the tests, with times given as offsets from one instant."""

from __future__ import annotations

from datetime import datetime, timedelta

T0 = datetime(2024, 1, 1, 12, 0, 0)


def at(**offset) -> datetime:
    return T0 + timedelta(**offset)


def stamp(moment: datetime) -> str:
    return moment.isoformat(sep=" ")


def frame(spark, schema: str, rows):
    return spark.createDataFrame(rows, schema)


def got(df, *columns):
    rows = df.select(*columns).collect()
    return sorted([tuple(r) for r in rows], key=repr)


BARRIERS = "ns string, name string, created_at timestamp, expected int, quorum int, timeout interval day to second"
ARRIVALS = "ns string, barrier string, holder string, arrived_at timestamp, seq long"
SEMAPHORES = "ns string, name string, permits int"
PERMITS = "ns string, semaphore string, holder string, acquired_at timestamp, expires_at timestamp, seq long, phase string"
LEASES = "ns string, name string, ttl interval day to second, holder string, acquired_at timestamp, expires_at timestamp"
REQUESTS = "ns string, lease string, holder string, priority int, requested_at timestamp, seq long, phase string"
LOCK_OPS = "ns string, name string, op string, holder string, ts timestamp, seq long, ttl interval day to second"
CONDITION = "struct<type:string,name:string,namespace:string,state:string,value:int>"
GATES = f"ns string, name string, created_at timestamp, timeout interval day to second, conditions array<{CONDITION}>"
RESOURCES = "kind string, ns string, name string, phase string, available long, succeeded long"
