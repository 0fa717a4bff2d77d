"""Near-duplicate documents by b-bit MinHash (operator 10).

Each text becomes a set of distinct word shingles; equal sets are one class from the start. A set has
128 minima; their two low bits are packed into four numbers, and groups of four minima are
the band keys: two sets of similarity 0.8 share none of the 32 bands with probability 5e-8.
Sets in a band are candidates. Their similarity is estimated from bit counts, corrected for
the quarter of positions that agree by chance, and only what may reach the limit is confirmed
on the full sets, recomputed from the texts.

A band is never expanded into all its pairs. First every set is confirmed against one other, the likeliest
of those that are the centre of a band with it; in a second round every component that shares a band with
the centre of another tries the likeliest such pair. Centres are of the band's largest component, so the confirmed
pairs of a round are a forest, whose roots are found by a few jumps and name the components of the next round.
Bands that then still mix components are joined to clusters, and within a
cluster each member outside the largest component is compared with the members of other components, on bit counts and,
where those allow, on the full sets; only one row per two components leaves the join. All links between different
components have then been looked at, and links in all are about as many as sets.

Defined cases: a null text or one without words has no shingles and is linked with nothing; fewer
words than a shingle form one shingle; a null doc_id takes part and gets its component's
smallest id, but is never kept as that; repeated rows have equal sets; an empty table gives an
empty result; of the input only doc_id and text are read, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordlytics.llm.graph import components
from coordlytics.llm.prefilter import possible
from coordlytics.llm.shingles import shingle_sets
from coordlytics.llm.store import scratch, stored
from coordlytics.llm.words import READ_BYTES, Reader, mixed, text_slices

MINIMA, ROWS = 128, 4
BANDS = MINIMA // ROWS
MINORS = 128  # members outside the largest component that one group of a cluster takes
ROUNDS = 2  # in which each component tries one pair before clusters are compared
#: An estimate this far below the limit, six standard deviations, rules a pair out.
SLACK = 0.25


@dataclass(frozen=True)
class Signature:
    sizes: np.ndarray
    ids: list[bytes | None]
    planes: np.ndarray  # four 64-bit numbers: low bits, then high bits, of the 128 minima
    bands: np.ndarray


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:MINIMA] | np.uint64(1), seeds[MINIMA:]


def signatures(hashes: np.ndarray, first: np.ndarray) -> Signature:
    sizes = np.diff(first)
    full = np.flatnonzero(sizes)
    minima = np.zeros((len(full), MINIMA), np.uint64)
    if len(full):
        factors, offsets = _multipliers()
        at = first[:-1][full]
        for j in range(MINIMA):
            minima[:, j] = np.minimum.reduceat(hashes * factors[j] + offsets[j], at)
    minima = mixed(minima)
    places = np.uint64(1) << np.arange(64, dtype=np.uint64)
    planes = np.zeros((len(sizes), 4), np.uint64)
    for bit in range(2):
        on = (minima >> np.uint64(bit)) & np.uint64(1)
        for half in range(2):
            planes[full, 2 * bit + half] = (on[:, 64 * half: 64 * half + 64] * places).sum(axis=1, dtype=np.uint64)
    keys = np.zeros((len(full), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + minima[:, r::ROWS])
    keys = mixed(keys + np.arange(BANDS, dtype=np.uint64))
    bands = np.zeros((len(sizes), BANDS), np.uint64)
    bands[full] = keys
    # a set's name: two independent sums over its members and its size
    ids: list[bytes | None] = [None] * len(sizes)
    if len(full):
        at = first[:-1][full]
        one = np.add.reduceat(mixed(hashes + np.uint64(0x1234567)), at) + sizes[full].astype(np.uint64)
        two = np.add.reduceat(mixed(hashes ^ np.uint64(0xABCDEF0123)) * np.uint64(3), at)
        for d, x, y in zip(full, one, two):
            ids[d] = int(x).to_bytes(8, "big") + int(y).to_bytes(8, "big")
    return Signature(sizes, ids, planes, bands)


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, tid (of the text), n, sid (of the set), planes p0 to p3 and bands of every row."""
    chosen = docs.select(
        F.col("doc_id"), F.unhex(F.md5(F.col("text").cast("string"))).alias("tid"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(fold=True)
        for batch in batches:
            for start, stop, data, offsets in text_slices(batch.column(2), READ_BYTES):
                own = signatures(*shingle_sets(reader, reader.read(data, offsets), width))
                rows = stop - start
                planes = [pa.array(own.planes[:, i].view(np.int64)) for i in range(4)]
                bands = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, (rows + 1) * BANDS, BANDS, dtype=np.int32)),
                    pa.array(own.bands.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, rows), batch.column(1).slice(start, rows), pa.array(own.sizes, pa.int64()),
                     pa.array(own.ids, pa.binary()), *planes, bands],
                    ["doc_id", "tid", "n", "sid", "p0", "p1", "p2", "p3", "bands"])

    id_type = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(
        run, f"doc_id {id_type}, tid binary, n long, sid binary, p0 long, p1 long, p2 long, p3 long, bands array<long>")


def _differing(a: str, b: str) -> Column:
    """In how many of the minima the low bits differ."""
    x, y = (lambda name: F.col(f"{a}.{name}")), (lambda name: F.col(f"{b}.{name}"))
    return sum((F.bit_count(x(f"p{h}").bitwiseXOR(y(f"p{h}")).bitwiseOR(x(f"p{h + 2}").bitwiseXOR(y(f"p{h + 2}"))))
                for h in range(2)), F.lit(0))


def _possible(a: str, b: str, percent: int) -> Column:
    """Sizes and bit counts allow the similarity."""
    x, y = (lambda name: F.col(f"{a}.{name}")), (lambda name: F.col(f"{b}.{name}"))
    agreeing = 1 - _differing(a, b) / MINIMA
    estimate = (agreeing - 0.25) / 0.75
    return ((100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n")))
            & (estimate >= percent / 100 - SLACK))


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The rows (id, parent) of ``pairs`` whose sets a and b are similar enough, by their full texts."""
    held = (
        pairs.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("sid").alias("b"), F.col("text").alias("text_b")), "b")
        .select("id", "parent", "text_a", "text_b"))

    def sets(reader: Reader, texts: pa.Array) -> Iterator[np.ndarray]:
        for start, stop, data, offsets in text_slices(texts, READ_BYTES):
            hashes, first = shingle_sets(reader, reader.read(data, offsets), width)
            for d in range(stop - start):
                yield hashes[first[d]: first[d + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(fold=True)
        for batch in batches:
            good = []
            for x, y in zip(sets(reader, batch.column(2)), sets(reader, batch.column(3))):
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["id", "parent"]).filter(pa.array(good, pa.bool_()))

    return held.mapInArrow(run, "id binary, parent binary")


def shingled(texts: DataFrame, width: int) -> DataFrame:
    """(sid, shingles): the full set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(fold=True)
        for batch in batches:
            for start, stop, data, offsets in text_slices(batch.column(1), READ_BYTES):
                hashes, first = shingle_sets(reader, reader.read(data, offsets), width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start),
                     pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))],
                    ["sid", "shingles"])

    return texts.select("sid", "text").mapInArrow(run, "sid binary, shingles array<long>")


def _across(clustered: DataFrame, percent: int) -> DataFrame:
    """(a, b): components of a cluster with a link between them, confirmed on the full sets in the join itself."""
    held = clustered.groupBy("cluster", "comp").agg(F.count("*").alias("c"))
    sizes = held.groupBy("cluster").agg(
        F.max(F.struct("c", "comp"))["comp"].alias("main"), (F.sum("c") - F.max("c")).alias("minors"))
    groups = sizes.withColumn("groups", F.ceil(F.col("minors") / MINORS).cast("int")).filter("groups > 0").drop("minors")
    rows = clustered.join(groups, "cluster").select("cluster", "groups", "main", F.struct(
        "sid", "comp", "n", "p0", "p1", "p2", "p3", "shingles").alias("m"))
    minor = rows.filter(F.col("m.comp") != F.col("main")).select(
        "cluster", F.pmod(F.xxhash64("m.sid"), F.col("groups")).cast("int").alias("part"), F.col("m").alias("x"))
    every = rows.select("cluster", "main", "m", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"))
    common = F.size(F.array_intersect("x.shingles", "m.shingles"))
    alike = 100 * common >= percent * (F.col("x.n") + F.col("m.n") - common)
    found = minor.join(every, ["cluster", "part"]).filter(
        (F.col("x.comp") != F.col("m.comp")) & ((F.col("m.comp") == F.col("main")) | (F.col("x.sid") < F.col("m.sid")))
        & _possible("x", "m", percent) & alike)
    x, y = F.col("x.comp"), F.col("m.comp")
    return found.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _likeliest(full: DataFrame, draw: int, percent: int) -> DataFrame:
    """(id, parent, a, b): for every component of ``full`` (key, comp and a set's traits) the pair of one of its sets
    and a band's centre of another component whose bits agree best. A centre is of the largest component
    of its band, the lowest by hash of several, so no chain of parents returns."""
    row = F.struct("sid", "comp", "n", "p0", "p1", "p2", "p3")
    order = F.struct(
        (-F.col("size")).alias("s"), F.xxhash64("comp", F.lit(draw)).alias("h"), F.col("comp"),
        F.xxhash64("sid", F.lit(draw)).alias("g"), row.alias("c"))
    centres = full.groupBy("key").agg(F.min(order)["c"].alias("c"))
    pairs = full.select("key", row.alias("m")).join(centres, "key").filter(
        (F.col("m.comp") != F.col("c.comp")) & _possible("m", "c", percent))
    best = pairs.groupBy(F.col("m.comp").alias("id")).agg(F.min(F.struct(
        _differing("m", "c").alias("d"), F.col("m.sid").alias("m"), F.col("c.sid").alias("c"), F.col("c.comp").alias("comp"))).alias("best"))
    return best.select("id", F.col("best.comp").alias("parent"), F.col("best.m").alias("a"), F.col("best.c").alias("b"))


def rooted(parents: DataFrame) -> DataFrame:
    """(id, component): the root above every node of a forest that is none itself, by jumps of doubling length.
    ``parents``: id, parent, one row per id."""
    now = parents
    while True:
        above = now.select(F.col("id").alias("parent"), F.col("parent").alias("next"))
        ahead = stored(now.select("id", "parent").join(above, "parent", "left").select(
            "id", F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("moved")), "jumps")
        if ahead.filter("moved").isEmpty():
            return ahead.select("id", F.col("parent").alias("component"))
        now = ahead


def _sized(found: DataFrame) -> DataFrame:
    """(comp, root, larger): every component that takes part in a round, its root and how many now are one."""
    counts = found.groupBy("component").agg((F.count("*") + 1).alias("larger"))
    below = found.join(counts, "component").select(F.col("id").alias("comp"), F.col("component").alias("root"), "larger")
    return below.unionByName(counts.select(F.col("component").alias("comp"), F.col("component").alias("root"), "larger"))


def _renamed(named: DataFrame, more: DataFrame) -> DataFrame:
    """(id, component) after components of ``named`` have got new ones by ``more``. No id is in both."""
    onward = more.select(F.col("id").alias("component"), F.col("component").alias("next"))
    return named.join(onward, "component", "left").select(
        "id", F.coalesce("next", "component").alias("component")).unionByName(more)


def linked_sets(sets: DataFrame, texts_of: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, component) of the sets that are linked with others; a component's own name may be missing among the ids.
    ``sets``: one row per sid."""
    traits = ["n", "p0", "p1", "p2", "p3"]
    members = sets.select("sid", F.explode("bands").alias("key"))
    crowded = members.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    shared = members.join(crowded, "key")
    now = stored(shared.join(sets.select("sid", "tid", *traits), "sid").withColumn("comp", F.col("sid")), "bands")
    chosen = stored(now.select("tid", "sid").distinct(), "chosen")
    texts = possible(texts_of, F.col("tid"), chosen, F.col("tid"))[0].join(chosen, "tid").select("sid", "text").dropDuplicates(["sid"])
    texts = stored(texts, "texts")
    now = now.drop("tid").withColumn("size", F.lit(1).cast("long"))
    named = None
    for draw in range(ROUNDS):
        pairs = stored(_likeliest(now, draw, percent), "star-pairs")
        found = rooted(stored(confirmed(pairs, texts, width, percent), "star-links"))
        named = found if named is None else _renamed(named, found)
        now = now.drop("low").join(_sized(found), "comp", "left").select(
            "key", "sid", *traits, F.coalesce("root", "comp").alias("comp"), F.coalesce("larger", "size").alias("size"))
        mixed_keys = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
        now = stored(now.join(mixed_keys.select("key", "low"), "key"), "open")
    clusters = components(now.select(F.col("comp").alias("a"), F.col("low").alias("b")))
    inside = now.select("sid", "comp", *traits).distinct().join(
        clusters.select(F.col("id").alias("comp"), F.col("component").alias("cluster")), "comp")
    shingles = shingled(texts.join(now.select("sid").distinct(), "sid", "left_semi"), width)
    clustered = stored(inside.join(shingles, "sid"), "clusters")
    more = stored(_across(clustered, percent), "cluster-links")
    return _renamed(named, components(more))


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, tid and n of every row, and of its component the smallest doc_id and the first (id, text);
    both are null without shingles."""
    sketched = stored(sketch(docs.select("doc_id", "text"), width), "sketch")
    sets = sketched.filter("n > 0").select("sid", "tid", "n", "p0", "p1", "p2", "p3", "bands").dropDuplicates(["sid"])
    texts_of = docs.select(F.unhex(F.md5(F.col("text").cast("string"))).alias("tid"), F.col("text").cast("string").alias("text"))
    with scratch(docs.sparkSession) as step:
        owners = step.keep(linked_sets(stored(sets, "sets"), texts_of, width, percent), "linked-sets")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tid")
    classes = sketched.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("low"), F.min(place).alias("first"))
    named = classes.join(owners.withColumnRenamed("id", "sid"), "sid", "left").select(
        "sid", "low", "first", F.coalesce("component", "sid").alias("component"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"), F.min("first").alias("first"))
    of_set = stored(
        named.select("sid", "component").join(lowest, "component").select(F.col("sid").alias("s"), "component_id", "first"), "components")
    return sketched.select("doc_id", "tid", "n", "sid").join(of_set, F.col("sid") == F.col("s"), "left").drop("sid", "s")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept and text_md5 of every row.

    ``width`` words make a shingle; sets are linked from ``percent`` percent of shared shingles on.
    """
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return _grouped(docs, width, percent).select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), F.col("tid").alias("text_md5"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, all columns: the smallest id, nulls last, then the lowest MD5 of the text, then of
    the row as JSON. Texts without shingles all stay."""
    leads = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tid") == F.col("first.tid"))
    # rows of one id and text are of one set, so all of them lead or none does
    held = _grouped(docs, width, percent).filter("n > 0").groupBy(F.col("doc_id").alias("held_id"), F.col("tid").alias("held_text")).agg(
        F.count("*").alias("c"), F.bool_and(leads).alias("leads"))
    found = stored(held.filter("not leads or c > 1").drop("c"), "near-duplicates")
    rows, others = possible(docs.select(F.struct("*").alias("row")), F.col("row.doc_id"), found, F.col("held_id"))
    text = F.unhex(F.md5(F.col("row.text").cast("string")))
    same = F.col("row.doc_id").eqNullSafe(F.col("held_id")) & (text == F.col("held_text"))
    again = rows.join(found.filter("leads"), same, "left_semi").groupBy(F.col("row.doc_id").alias("d"), text.alias("t")).agg(
        F.min_by("row", F.md5(F.to_json("row"))).alias("row"))
    return others.unionByName(rows.join(found, same, "left_anti")).unionByName(again.select("row")).select("row.*")
