"""V1, V3-V6: column rules shared by every operator. All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The duration syntax of spec fields, its units in nanoseconds, and the defaults.
DURATION_PATTERN = r"^([0-9]+(\.[0-9]+)?(ns|us|µs|ms|s|m|h))+$"
DURATION_PART = r"([0-9]+(?:\.[0-9]+)?(?:ns|us|µs|ms|s|m|h))"
UNIT_NANOS = {
    "ns": 1, "us": 1_000, "µs": 1_000, "ms": 1_000_000,
    "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000,
}
LONGEST = 9_200_000_000_000_000_000_000  # nanoseconds
DEFAULT_TTL = "make_dt_interval(0, 0, 10)"
DEFAULT_WAIT = "make_dt_interval(0, 0, 0, 30)"
DEFAULT_NAMESPACE = "default"


def duration_micros(text: Column) -> Column:
    """Whole microseconds of a duration text, null when it is malformed; finer parts truncate."""
    unit = lambda part: F.regexp_extract(part, r"[a-zµ]+$", 0)
    number = lambda part: F.regexp_extract(part, r"^[0-9.]+", 0)

    def nanos(part):
        # digits in front of the point and behind it apart: nothing that fits the result overflows on the way
        whole = F.substring_index(number(part), ".", 1).try_cast("decimal(22,0)")
        # null without a fraction, and digits behind the ninth are below any unit's nanosecond
        rest = F.rpad(F.substring(F.regexp_extract(number(part), r"\.([0-9]+)", 1), 1, 13), 13, "0").cast("decimal(13,0)")
        out = F.lit(None).cast("decimal(38,0)")
        for name, n in UNIT_NANOS.items():
            factor = F.lit(n).cast("decimal(14,0)")
            whole_part = F.try_multiply(whole, factor).try_cast("decimal(36,0)")
            rest_part = F.floor(rest * factor / F.lit(10**13).cast("decimal(14,0)")).cast("decimal(36,0)")
            out = F.when(unit(part) == name, F.try_add(whole_part, rest_part).try_cast("decimal(38,0)")).otherwise(out)
        return out

    parts = F.regexp_extract_all(text, F.lit(DURATION_PART), 1)
    total = F.aggregate(
        parts, F.lit(0).cast("decimal(38,0)"), lambda acc, p: F.try_add(acc, nanos(p)).try_cast("decimal(38,0)"))
    micros = F.floor(F.try_divide(total, F.lit(1000)))
    # longer than an interval can hold is no duration
    return F.when(text.rlike(DURATION_PATTERN) & (total < F.lit(str(LONGEST)).cast("decimal(38,0)")), micros.try_cast("long"))


def micros_interval(micros: Column) -> Column:
    # whole seconds and the rest apart, so that large values keep their precision
    seconds = (micros.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.when(micros.isNotNull(), F.make_dt_interval(zero, zero, zero, seconds))


def parse_durations(df: DataFrame, col: str) -> DataFrame:
    """V1: adds ``<col>_interval`` and ``<col>_valid``; a null text is valid and has no interval, one beyond any
    interval is invalid."""
    return df.withColumns({
        f"{col}_interval": micros_interval(duration_micros(F.col(col))),
        f"{col}_valid": F.col(col).isNull() | duration_micros(F.col(col)).isNotNull(),
    })


def none_if_empty(col: Column | str) -> Column:
    return F.nullif(F.col(col) if isinstance(col, str) else col, F.lit(""))


def effective_holder(df: DataFrame) -> DataFrame:
    """V3: the named holder, else the host, else a name made from the operation time."""
    named = F.coalesce(
        none_if_empty("holder"), none_if_empty("hostname"),
        F.concat(F.lit("sdk-"), F.unix_timestamp("ts").cast("string")))
    return df.withColumn("effective_holder", named)


def effective_namespace(df: DataFrame, parent: str = "parent_ns") -> DataFrame:
    """V4: an empty namespace means the parent's, and the default one when there is none."""
    return df.withColumn(
        "effective_ns", F.coalesce(none_if_empty("ns"), none_if_empty(parent), F.lit(DEFAULT_NAMESPACE)))


def expiry(start: Column, ttl: Column) -> Column:
    """start + ttl when the ttl is positive, else null (never expires)."""
    return F.when(ttl > F.expr("make_dt_interval(0)"), start + ttl)


def effective_expiry(df: DataFrame, start: str = "acquired_at", use_default: bool = True) -> DataFrame:
    """V5: ``expires_at`` from the row's ttl; a missing ttl means ten minutes if ``use_default``."""
    ttl = F.coalesce("ttl", F.expr(DEFAULT_TTL)) if use_default else F.col("ttl")
    return df.withColumn("expires_at", expiry(F.col(start), ttl))


def permit_live(as_of: Column) -> Column:
    """A permit is dead at the very instant it expires."""
    return F.col("expires_at").isNull() | (F.col("expires_at") > as_of)


def lock_live(as_of: Column) -> Column:
    """A lock or lease is still alive at the very instant it expires."""
    return F.col("expires_at").isNull() | (F.col("expires_at") >= as_of)


def is_live(df: DataFrame, as_of: str, permits: bool) -> DataFrame:
    """V6: both boundary rules, chosen by ``permits``."""
    rule = permit_live if permits else lock_live
    return df.withColumn("live", rule(instant(as_of)))


def instant(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def micros(col: str | Column) -> Column:
    return F.unix_micros(F.col(col) if isinstance(col, str) else col)


def seconds_between(start: str | Column, end: str | Column) -> Column:
    """Whole seconds from start to end, rounded down."""
    return F.floor((micros(end) - micros(start)) / 1_000_000).cast("long")
