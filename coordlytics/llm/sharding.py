"""Shards of equal numbers of documents that keep linked documents together, by balanced label propagation (operator 4).

Documents are linked by sharing a group: an equal text, and any (doc_id, group) the caller gives, where a group of two is a
link. Linked documents start in shards drawn from their ids. In each round every group counts the shards its members
are in now, every document adds up the counts of its groups and wishes for the shard with most of
them that has room; wishes are granted where two shards exchange equally many or where a shard has room, members of large groups
first. Then groups count again. It ends when no wish helps, or when no round has
lowered the number of cut pairs (members of a group in different shards) for a while; the best labels count. Documents without links then
fill all shards to exactly their quota.

The law is `rows`: the numbers of documents of any two shards differ by one at most. The driver holds one number per
pair of shards. Running totals are two-level, so neither a shard nor a group is sorted by one task, and a group's
counts are summed before they are shuffled.

Defined cases: a null text has size 1 and checksum 0 and is linked with nothing by its text; equal empty texts are linked;
null and repeated ids are documents like any other, rows alike in everything are exchangeable; groups of one document and unknown
ids in ``members`` link nothing; an empty table gives an empty result; carried columns travel in a struct, so no name can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordlytics.llm.prefix import running, shuffled_key
from coordlytics.llm.store import stored

PATIENCE = 3  # rounds without fewer cut pairs


def _of(numbers: list[int], place: Column) -> Column:
    return F.get(F.array(*[F.lit(n).cast("long") for n in numbers]), place)


def _largest_first(size: Column, group: Column) -> Column:
    """Two digits of the size, in quarters of its logarithm, then a hash."""
    return F.concat(F.lpad(F.hex(F.lit(255) - F.floor(4 * F.log2(size)).cast("int")), 2, "0"), F.md5(F.hex(group)))


@dataclass
class Propagated:
    labels: DataFrame  # doc, shard
    cuts: list[float]  # pairs of a group's members in different shards, before the first round and after each


def votes_of(members: DataFrame, labels: DataFrame, shards: int) -> DataFrame:
    """(hub, n, votes): how many members each group has now in each shard."""
    counted = members.join(labels, "doc").groupBy("hub").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("shard") == s).alias(f"v{s}") for s in range(shards)])
    return counted.select("hub", "n", F.array(*[f"v{s}" for s in range(shards)]).alias("votes"))


def _wishes(members: DataFrame, labels: DataFrame, votes: DataFrame, room: list[int]) -> DataFrame:
    """doc, shard, wish and key of the documents that want to move."""
    shards = len(room)
    heard = members.join(votes, "hub").groupBy("doc").agg(
        F.max(F.struct("n", "hub")).alias("top"), F.count("*").alias("hubs"), *[F.sum(F.get("votes", F.lit(s))).alias(f"v{s}") for s in range(shards)])
    hub, here = F.col("top.hub"), F.col("shard")
    # a document counts once where it is, whatever the number of its groups
    heard_in = lambda s: F.col(f"v{s}") - F.when(here == s, F.col("hubs") - 1).otherwise(0)
    option = lambda s: F.struct(heard_in(s).alias("votes"), F.xxhash64(hub, F.lit(s)).alias("draw"), F.lit(s).alias("shard"))
    # ties are broken by the group, so that its members agree
    options = F.array(*[F.when(F.lit(r > 0) | (here == s), option(s)) for s, r in enumerate(room)])
    wished = heard.join(labels, "doc").select("doc", "shard", F.array_max(options)["shard"].alias("wish"), _largest_first(F.col("top.n"), hub).alias("key"))
    return wished.filter("wish <> shard")


def grants(flows: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many documents may go from each shard to each other one: equal exchanges, and what has room."""
    out = {(s, t): min(n, flows.get((t, s), 0)) for (s, t), n in flows.items()}
    for t, free in enumerate(room):
        wanting = {s: n - out[s, t] for (s, to), n in sorted(flows.items()) if to == t and n > out[s, t]}
        total, left = sum(wanting.values()), free
        for s, n in wanting.items():
            share = min(n, left, -(-free * n // total))
            out[s, t] += share
            left -= share
    return out


def propagate(members: DataFrame, labels: DataFrame, quota: list[int]) -> Propagated:
    """Move the documents of ``labels`` (doc, shard) towards those they share groups with (``members``: doc, hub)."""
    shards = len(quota)
    best, cuts, since = labels, [], 0
    while True:
        votes = stored(votes_of(members, labels, shards), "shard-votes")
        together = F.aggregate("votes", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
        cuts.append(votes.agg(F.sum((F.col("n").cast("double") * F.col("n") - together) / 2).alias("n")).first()["n"] or 0.0)
        if len(cuts) == 1 or cuts[-1] < min(cuts[:-1]):
            best, since = labels, 0
        else:
            since += 1
        if cuts[-1] == 0 or since >= PATIENCE:
            return Propagated(best, cuts)
        held = {r["shard"]: r["count"] for r in labels.groupBy("shard").count().collect()}  # a row per shard
        room = [max(0, q - held.get(s, 0)) for s, q in enumerate(quota)]
        wishes = stored(_wishes(members, labels, votes, room), "shard-wishes")
        flows = {(r["shard"], r["wish"]): r["count"] for r in wishes.groupBy("shard", "wish").count().collect()}  # a row per pair of shards
        granted = grants(flows, room)
        if not sum(granted.values()):
            return Propagated(best, cuts)
        flat = [granted.get((s, t), 0) for s in range(shards) for t in range(shards)]
        ranked = running(wishes.withColumn("one", F.lit(1).cast("long")), ["shard", "wish"], "key", ["doc"], "one", "rank", digits=4)
        moved = ranked.filter(F.col("rank") <= _of(flat, F.col("shard") * shards + F.col("wish"))).select("doc", "wish")
        labels = stored(labels.join(moved, "doc", "left").select("doc", F.coalesce("wish", "shard").alias("shard")), "shard-labels")


def sharded(docs: DataFrame, shards: int = 16, columns: list[str] | None = None, text: str = "text",
            members: DataFrame | None = None) -> DataFrame:
    """``row`` (the given columns, all by default), size, text_crc32, shard and slot of every row.

    ``members`` (doc_id, group) links documents besides those of equal text.
    """
    carried = docs.columns if columns is None else columns
    body, kept = F.col(f"`{text}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = stored(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), (F.octet_length(kept) + 1).cast("long").alias("size"),
        F.crc32(kept).alias("text_crc32"), F.unhex(F.md5(body)).alias("gid"), F.monotonically_increasing_id().alias("doc"),
        shuffled_key(F.lit("shard"), F.col("doc_id"), F.md5(kept)).alias("key"), F.col("doc_id").alias("__doc_id")), "shard-rows")
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    pairs = rows.filter("gid is not null").select("doc", F.col("gid").alias("hub"))
    if members is not None:
        given = members.select(F.col("doc_id").alias("__doc_id"), F.unhex(F.md5(F.concat(F.lit("group "), F.col("group").cast("string")))).alias("hub"))
        pairs = pairs.unionByName(rows.join(given, "__doc_id").select("doc", "hub")).distinct()
    several = pairs.groupBy("hub").agg(F.count("*").alias("n")).filter("n > 1").select("hub")
    pairs = stored(pairs.join(several, "hub"), "shard-members")
    linked = rows.join(pairs.select("doc").distinct(), "doc", "left_semi").select("doc", "key", F.lit(1).cast("long").alias("one"))
    many = linked.count()
    start = running(linked, [], "key", ["doc"], "one", "rank").select(
        "doc", F.floor((F.col("rank") - 1) * shards / F.lit(max(1, many))).cast("int").alias("shard"))
    labels = propagate(pairs, stored(start, "shard-labels"), quota).labels
    held = {r["shard"]: r["count"] for r in labels.groupBy("shard").count().collect()}  # a row per shard
    ends = [0]
    for s, q in enumerate(quota):
        ends.append(ends[-1] + q - held.get(s, 0))
    ranked = running(rows.join(labels, "doc", "left_anti").select("doc", "key", F.lit(1).cast("long").alias("one")), [], "key", ["doc"], "one", "rank")
    filled = ranked.select("doc", F.coalesce(*[F.when(F.col("rank") <= e, s) for s, e in enumerate(ends[1:])]).alias("shard"))
    placed = stored(rows.drop("gid", "__doc_id").join(labels.unionByName(filled), "doc").withColumn("one", F.lit(1).cast("long")), "sharded")
    return running(placed, ["shard"], "key", ["doc"], "one", "place").select(
        "row", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("place") - 1).cast("long").alias("slot"))
