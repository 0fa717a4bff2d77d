"""Run-once claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from coordlytics.functions.columns import instant
from coordlytics.operators.relations import KEY

def position():
    return F.struct("ts", "seq")


def once_winner(claims: DataFrame) -> DataFrame:
    """O1: the first claim whose work succeeded; a failed one is rolled back and leaves the key free."""
    return claims.filter("ok").groupBy(*KEY).agg(
        F.min_by(F.struct("executor", F.col("ts").alias("executed_at"), F.col("seq").alias("win_seq")), position()).alias("w")
    ).select(*KEY, "w.*")


def once_attempts(claims: DataFrame) -> DataFrame:
    """O2: what became of every claim, told by its place before, at or after the winner."""
    winner = once_winner(claims).select(*KEY, F.struct("executed_at", "win_seq").alias("won"))
    at = F.struct(F.col("won.executed_at").alias("ts"), F.col("won.win_seq").alias("seq"))
    before = F.col("won").isNull() | (position() < at)
    outcome = (
        F.when(before, "failed_rolled_back")
        .when(position() == at, "executed").otherwise("skipped_already_executed"))
    return claims.join(winner, KEY, "left").select(*KEY, "executor", "ts", "seq", outcome.alias("outcome"))


def once_status(onces: DataFrame, claims: DataFrame, as_of: str) -> DataFrame:
    """O3: Pending or Executed for keys that exist at ``as_of`` and have not outlived their ttl."""
    now = instant(as_of)
    alive = onces.filter((F.col("created_at") <= now) & (F.col("ttl").isNull() | (now <= F.col("created_at") + F.col("ttl"))))
    won = once_winner(claims.filter(F.col("ts") <= now)).drop("win_seq")
    executed = F.col("executor").isNotNull()
    return alive.join(won, KEY, "left").select(
        *KEY, executed.alias("executed"), "executor", "executed_at",
        F.when(executed, "Executed").otherwise("Pending").alias("phase"))


def once_pending(onces: DataFrame, claims: DataFrame) -> DataFrame:
    """Keys whose work never succeeded."""
    return onces.join(claims.filter("ok").select(*KEY), KEY, "left_anti")


def duplicate_executions(executions: DataFrame) -> DataFrame:
    """Keys that report more than one execution."""
    return executions.groupBy(*KEY).agg(F.count(F.lit(1)).alias("executions")).filter("executions > 1")
