"""Mixing sources to target weights by weighted fair queueing (operator 1, native).

Documents of a source are put in a repeatable random order and run through up to ``most``
times. A document's virtual finish time is the number of words of its source up to and including it,
divided by the source's weight. All documents in order of finish time, cut off where
the budget is used up, are the mix: sources advance in proportion to their weights, and one that
has no repeats left drops out while the others go on.

The cut is found without a global sort: words are summed in ranges of finish time (map-side,
a fixed number of ranges), the range in which the budget ends is divided again, and only what is
left of it is ordered.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own and
comes last; a null doc_id is an id like any other; rows alike in id, size and source are
exchangeable; an empty table or one without words gives targets of 0; input columns travel in a
struct, so no name can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordlytics.llm.prefix import running, shuffled_key
from coordlytics.llm.store import stored

WORD = r"[^\x20\x09-\x0D]+"
RANGES = 4096


@dataclass(frozen=True)
class Mix:
    """``rows``: the input in ``row`` with its size and place; ``sources``: one row each with its target."""

    rows: DataFrame
    sources: DataFrame
    cut_finish: float
    cut_rank: int
    most: int

    def taken(self) -> Column:
        """How often the mix takes a row."""
        def passed(turn: int) -> Column:
            finish = (F.col("cum") + F.col("source_size") * turn) / F.col("weight")
            return ((finish < self.cut_finish) | ((finish == self.cut_finish) & (F.col("rank") <= self.cut_rank))).cast("int")

        times = sum((passed(t) for t in range(1, self.most)), passed(0))
        return F.when(F.col("size") > 0, times).otherwise(0)


def source_targets(sources: DataFrame, weights: Column | None, most: int) -> DataFrame:
    """Adds rank, weight and target. Targets fill up in proportion to the weights until all words are dealt out."""
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    default = ((F.col("rank") - 1) % 3 + 1).cast("double")
    weighed = ranked.withColumn("weight", default if weights is None else weights.cast("double"))
    weighed = weighed.withColumn("cap", (F.col("source_size") * most).cast("double"))
    full = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, rest = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = weighed.withColumn("budget", F.sum("source_size").over(everything).cast("double")).withColumn(
        "level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # the first source, in order of filling up, that the level does not fill sets the level for all behind it
    ratio = F.col("cap") / F.col("weight")
    level = F.min(F.when(F.col("level") <= ratio, F.struct(ratio.alias("ratio"), "rank", "level"))).over(everything)
    return (
        levels.withColumn("water", level["level"])
        .withColumn("target", F.least("cap", F.col("water") * F.col("weight")))
        .select("source", "source_size", "rank", "weight", "target"))


def _cut(rows: DataFrame, most: int) -> tuple[float, int]:
    """(finish time, source rank) of the last document that fits into the budget of all words."""
    turns = F.explode(F.array(*[F.lit(t) for t in range(most)]))
    items = rows.filter("size > 0").select(
        "size", "rank", "cum", "source_size", "weight", turns.alias("turn")).select(
        "size", "rank", ((F.col("cum") + F.col("source_size") * F.col("turn")) / F.col("weight")).alias("finish"))
    first = items.agg(
        F.max("finish").alias("top"), (F.sum("size") / most).cast("long").alias("budget")).first()
    if first["top"] is None:
        return -1.0, 0
    low, high, used, budget = 0.0, first["top"], 0, first["budget"]
    for _ in range(2):
        width = (high - low) / RANGES
        if width <= 0:
            break
        inside = items.filter((F.col("finish") >= low) & (F.col("finish") <= high))
        place = F.floor((F.col("finish") - low) / width)
        held = inside.groupBy(place.alias("place")).agg(F.sum("size").alias("n"), F.min("finish").alias("a"), F.max("finish").alias("b"))
        upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        found = held.withColumn("upto", F.sum("n").over(upto)).filter(F.col("upto") + used > budget).orderBy("place").first()
        if found is None:
            return high, 2**31 - 1
        low, high, used = found["a"], found["b"], used + found["upto"] - found["n"]
    last = items.filter((F.col("finish") >= low) & (F.col("finish") <= high))
    upto = Window.orderBy("finish", "rank").rowsBetween(Window.unboundedPreceding, 0)
    fits = last.withColumn("upto", F.sum("size").over(upto)).filter(F.col("upto") + used <= budget)
    end = fits.agg(F.max(F.struct("finish", "rank")).alias("end")).first()["end"]
    # nothing of the last range fits: the cut lies just in front of it
    return (end["finish"], end["rank"]) if end else (low, 0)


def mix(docs: DataFrame, weights: Column | None = None, most: int = 3, seed: str = "mix",
        columns: list[str] | None = None) -> Mix:
    """Plan the mix of ``docs`` (doc_id, text, source and any others; ``columns`` are carried along).

    ``weights`` is an expression over ``source`` and ``rank`` (from 1, by code point, null last); by
    default weights are 1, 2, 3, repeating. The budget is the number of all words.
    """
    carried = docs.columns if columns is None else columns
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col("source").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        shuffled_key(F.lit(seed), F.col("doc_id")).alias("key"), F.col("doc_id").cast("string").alias("id"))
    narrow = stored(sized.select("source", "size", "key", "id", *(["row"] if columns is not None else [])), "mix-sizes")
    sources = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    sources = stored(sources, "mix-sources")
    rows = narrow if columns is not None else sized
    placed = running(rows, ["source"], "key", ["id", "size"], "size", "cum")
    placed = placed.join(
        sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    if columns is not None:
        placed = stored(placed, "mix-rows")
        cut = _cut(placed, most)
    else:
        small = running(narrow, ["source"], "key", ["id", "size"], "size", "cum").join(
            sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
        cut = _cut(stored(small, "mix-rows"), most)
    return Mix(placed, sources, cut[0], cut[1], most)


def shares(docs: DataFrame, weights: Column | None = None, most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row."""
    plan = mix(docs, weights, most, columns=["doc_id"])
    return plan.rows.select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * plan.taken()).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Column | None = None, most: int = 3) -> DataFrame:
    """The mix itself: each document as often as it is taken, range-sorted by virtual finish time."""
    plan = mix(docs, weights, most)
    turns = plan.rows.withColumn("times", plan.taken()).filter("times > 0").select(
        "row", "cum", "rank", "weight", "source_size", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("turn"))
    finish = (F.col("cum") + F.col("source_size") * F.col("turn")) / F.col("weight")
    return (
        turns.withColumn("finish", finish).repartitionByRange("finish", "rank")
        .sortWithinPartitions("finish", "rank").select("row.*"))
