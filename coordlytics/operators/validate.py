"""V2: one row per broken rule of a spec or child row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from coordlytics.functions.columns import DURATION_PATTERN
from coordlytics.operators.relations import KEY

# The accepted condition types and states, and the known fields of each spec.
CONDITION_TYPES = ["Job", "Semaphore", "Barrier", "Lease", "Gate", "Mutex", "Once", "WaitGroup"]
CONDITION_STATES = [
    "Complete", "Failed", "Active", "Open", "Closed", "Acquired", "Available",
    "Locked", "Unlocked", "Done", "Pending", "Zero", "NonZero",
]
KNOWN_FIELDS = {
    "barrier": ["expected", "timeout", "quorum"],
    "semaphore": ["permits", "ttl"],
    "lease": ["ttl", "priority"],
    "mutex": ["ttl"],
    "rwmutex": ["ttl"],
    "once": ["ttl"],
    "waitgroup": ["ttl"],
    "gate": ["conditions", "timeout"],
}
META_FIELDS = ["ns", "name", "created_at", "labels"]

Rule = tuple[str, Callable[[], Column], str]


def at_least(col: str, least: int) -> Rule:
    return (f"{col}_min", lambda: F.col(col) < least, f"{col} must be at least {least}")


def required(col: str) -> Rule:
    return (f"{col}_required", lambda: F.col(col).isNull(), f"{col} is required")


def length(col: str, most: int) -> Rule:
    bad = lambda: (F.length(col) < 1) | (F.length(col) > most)
    return (f"{col}_length", bad, f"{col} must have 1 to {most} characters")


def duration(col: str) -> Rule:
    return (f"{col}_duration", lambda: ~F.col(col).rlike(DURATION_PATTERN), f"{col} is not a duration")


RULES: dict[str, list[Rule]] = {
    "barrier": [
        required("expected"), at_least("expected", 1), at_least("quorum", 1),
        ("quorum_max", lambda: F.col("quorum") > F.col("expected"), "quorum must not exceed expected"),
        duration("timeout")],
    "arrival": [required("barrier"), length("barrier", 63), required("holder"), length("holder", 253)],
    "semaphore": [required("permits"), at_least("permits", 1), duration("ttl")],
    "semaphore_status": [at_least("in_use", 0), at_least("available", 0)],
    "permit": [required("semaphore"), length("semaphore", 63), required("holder"), length("holder", 253), duration("ttl")],
    "lease": [duration("ttl")],
    "lease_request": [required("lease"), length("lease", 63), required("holder"), length("holder", 253), at_least("priority", 0), duration("ttl")],
    "mutex": [duration("ttl")],
    "rwmutex": [duration("ttl")],
    "once": [duration("ttl")],
    "waitgroup": [duration("ttl")],
    "waitgroup_status": [at_least("counter", 0)],
    "gate": [
        ("conditions_min", lambda: F.size("conditions") < 1, "a gate needs at least one condition"),
        ("condition_type", lambda: F.exists("conditions", lambda c: ~c["type"].isin(CONDITION_TYPES)), "unknown condition type"),
        ("condition_state", lambda: F.exists("conditions", lambda c: (c["state"] != "") & ~c["state"].isin(CONDITION_STATES)), "unknown condition state"),
        ("condition_name", lambda: F.exists("conditions", lambda c: F.coalesce(F.length(c["name"]), F.lit(0)) < 1), "a condition needs a name"),
        duration("timeout")],
}


#: The column of a child table that names its parent.
CHILD_PARENT = {"arrival": "barrier", "permit": "semaphore", "lease_request": "lease"}


def validate_specs(df: DataFrame, kind: str) -> DataFrame:
    """V2: violations as (ns, name, rule, message).

    Rules on columns the frame lacks are skipped, duration rules only apply to text. When the
    frame keeps its JSON text in ``raw``, fields the spec does not know are reported too.
    """
    types = dict(df.dtypes)
    found = []
    for name, broken, message in RULES[kind]:
        column = name.rsplit("_", 1)[0]
        if column in ("condition", "conditions"):
            column = "conditions"
        if column not in types or (name.endswith("_duration") and types[column] != "string"):
            continue
        row = F.struct(F.lit(name).alias("rule"), F.lit(message).alias("message"))
        found.append(F.when(broken(), row))
    checks = F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<rule:string,message:string>>")
    if "raw" in types:
        extra = F.array_except(
            F.json_object_keys("raw"), F.lit([*META_FIELDS, *KNOWN_FIELDS.get(kind, [])]))
        reported = F.transform(extra, lambda f: F.struct(
            F.lit("unknown_field").alias("rule"), F.concat(F.lit("unknown field "), f).alias("message")))
        checks = F.concat(checks, F.coalesce(reported, F.array().cast("array<struct<rule:string,message:string>>")))
    # children have no name of their own: they go by their parent and holder
    named = F.col("name") if "name" in types else F.concat_ws("/", F.col(CHILD_PARENT[kind]), F.col("holder"))
    return df.select("ns", named.alias("name"), F.explode(checks).alias("v")).select(*KEY, "v.rule", "v.message")
