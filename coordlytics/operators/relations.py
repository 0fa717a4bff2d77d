"""IO3-IO8: list, link and clean the relations the primitives are computed from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from coordlytics.plans.ordered import Prefix, ordered_scan
from coordlytics.sources.specs import LABEL

KEY = ["ns", "name"]


def list_kind(df: DataFrame, ns: str, selector: dict[str, str] | None = None) -> DataFrame:
    """IO3: rows of one namespace whose labels equal every entry of ``selector``.

    A label that has a column of its own (`sources.specs.write_clustered`) is compared there, which reaches the files.
    """
    rows = df.filter(F.col("ns") == ns)
    for label, value in (selector or {}).items():
        own = f"{LABEL}{label}"
        rows = rows.filter((F.col(own) if own in df.columns else F.col("labels")[label]) == value)
    return rows


def children_of(parents: DataFrame, children: DataFrame, label: str) -> DataFrame:
    """IO4: every parent with its children by label; parents without children stay."""
    linked = children.withColumn("name", F.col("labels")[label]).select(
        "ns", "name", *[F.col(c).alias(f"child_{c}") for c in children.columns if c not in ("ns", "labels", "name")])
    return parents.join(linked, KEY, "left")


def orphans(parents: DataFrame, children: DataFrame, parent: str) -> DataFrame:
    """IO5: children whose parent does not exist."""
    owners = parents.select("ns", F.col("name").alias(parent))
    return children.join(owners, ["ns", parent], "left_anti")


def label_spec_mismatch(children: DataFrame, parent: str) -> DataFrame:
    """IO6: children whose label names another parent than their spec does."""
    return children.filter(~F.col("labels")[parent].eqNullSafe(F.col(parent)))


def dedupe_creates(events: DataFrame, keys: list[str] = ["ns", "kind", "name"]) -> DataFrame:
    """IO7: the first create of every key; repeats are ignored.

    An aggregate rather than a ranking, so each task already reduces its rows to one per key.
    """
    rest = [c for c in events.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct("ts", "seq")).alias("first")
    return events.groupBy(*keys).agg(first).select(*keys, "first.*")


def status_changes(status_log: DataFrame, state: list[str], keys: list[str] = KEY) -> DataFrame:
    """IO8: status rows that differ from the row before, so that unchanged writes vanish."""
    marked = ordered_scan(
        status_log, keys, ["ts", "seq"], {"__before": Prefix("prev", F.struct(*state))})
    changed = ~F.col("__before").eqNullSafe(F.struct(*state))
    return marked.filter(F.col("__before").isNull() | changed).drop("__before")


def where_condition(status: DataFrame, condition: Column | str) -> DataFrame:
    """Rows that satisfy a caller's predicate, kept as a Catalyst expression."""
    return status.filter(condition)
