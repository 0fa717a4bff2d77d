"""Near-duplicate vectors by a subspace pigeonhole join (operator 7).

Unit vectors are rotated at random and split into blocks of about eight dimensions. Two vectors of
cosine c have squared distance 2 - 2c; if that is at most T, then in at least one block of share s of the
dimensions it is at most s x T. So every block is range-joined under its share of T: a grid over the
block's first two coordinates, with cells twice as wide as the range, brings possible partners
together, each pair in one cell. The union over the blocks is verified by the exact cosine.

Equal vectors with equal labels are one class and are joined once; a crowded cell is cut into tiles that
meet two at a time, so a task holds at most two tiles. A pair counts in the first block that finds it, so none counts
twice; a task gives back each vector's number of links and what they connect it to, never the
links themselves, however many of its vectors are alike.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components and
rows with a null label have no links and stand for themselves; vectors of different length
are not compared; a null vec_id counts as a link of others but names no component and
is never kept; repeated rows are linked copies; an empty table gives an empty result; only the
three columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordlytics.llm.graph import components
from coordlytics.llm.store import stored

BLOCK = 8  # dimensions, about
WIDTH = 2  # of a cell, in ranges
TILE = 2048  # vectors
SLACK = 1e-9  # for rounding of the block distances


def rotation(size: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


class Blocks:
    def __init__(self, size: int, cosine: float):
        self.turn = rotation(size)
        edges = np.linspace(0, size, max(1, round(size / BLOCK)) + 1).astype(int)
        self.parts = list(zip(edges[:-1], edges[1:]))
        self.budgets = [(2 - 2 * cosine) * (b - a) / size + SLACK for a, b in self.parts]
        self.cells = [WIDTH * np.sqrt(b) for b in self.budgets]

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        """Rotated unit vectors; summed row by row, so that a vector gives the same numbers in every batch."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        out = np.empty_like(unit)
        for begin in range(0, len(unit), 512):
            out[begin: begin + 512] = (unit[begin: begin + 512, :, None] * self.turn[None]).sum(axis=1)
        return out

    def within(self, j: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which rotated vectors of two lists are within reach of each other in block ``j``."""
        a, b = self.parts[j]
        return ((x[:, a:b] - y[:, a:b]) ** 2).sum(axis=1) <= self.budgets[j]

    def axes(self, j: int) -> range:
        a, b = self.parts[j]
        return range(a, min(a + 2, b))


def usable(vector: Column, label: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.split(flat, np.cumsum(column.value_lengths().to_numpy())[:-1]) if len(column) else []


def cells(classes: DataFrame, cosine: float) -> DataFrame:
    """Each vector in every cell it belongs to: (label, size, block, x, y, key, vector, m)."""
    kind = classes.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Blocks] = {}
        for batch in batches:
            vectors = _vectors(batch.column(2))
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes):
                of = blocks.setdefault(int(size), Blocks(int(size), cosine))
                rows = np.flatnonzero(sizes == size)
                turned = of.turned(np.stack([vectors[i] for i in rows]))
                for j in range(len(of.parts)):
                    width, reach = of.cells[j], np.sqrt(of.budgets[j])
                    places = []
                    for axis in of.axes(j):
                        home = np.floor(turned[:, axis] / width)
                        # also in the cell below, if a partner there may be within reach
                        near = np.floor((turned[:, axis] - reach) / width)
                        places.append((home, near))
                    if len(places) == 1:
                        places.append((np.zeros(len(rows)),) * 2)
                    for dx in range(2):
                        for dy in range(2):
                            x, y = places[0][dx], places[1][dy]
                            new = np.ones(len(rows), bool)
                            if dx:
                                new &= x != places[0][0]
                            if dy:
                                new &= y != places[1][0]
                            if not new.any():
                                continue
                            at = pa.array(rows[new])
                            n = int(new.sum())
                            yield pa.RecordBatch.from_arrays(
                                [batch.column(0).take(at), pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, j, np.int32)),
                                 pa.array(x[new].astype(np.int64)), pa.array(y[new].astype(np.int64)),
                                 batch.column(1).take(at), batch.column(2).take(at), batch.column(3).take(at)],
                                ["label", "size", "block", "x", "y", "key", "vector", "m"])

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("label", "key", "vector", "m").mapInArrow(
        run, f"label {label}, size int, block int, x long, y long, key binary, vector {kind}, m long")


def _lowest_connected(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each of ``n`` things the lowest one that the pairs (p, q) connect it to."""
    low = np.arange(n)
    while True:
        both = np.minimum(low[p], low[q])
        after = low.copy()
        np.minimum.at(after, p, both)
        np.minimum.at(after, q, both)
        after = after[after]
        if (after == low).all():
            return low
        low = after


def links(classes: DataFrame, cosine: float) -> DataFrame:
    """(a, b, linked), summed or connected over all rows: how many vectors of other classes with the same label
    have a cosine of at least ``cosine`` with those of class a, and a class b it is connected with, if another.
    ``classes``: label, key, vector and the number m of vectors."""
    cell = ["label", "size", "block", "x", "y"]
    placed = stored(cells(classes, cosine), "cells")
    crowd = placed.groupBy(*cell).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    drawn = placed.join(crowd, cell).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    meeting = drawn.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        *cell, F.least("tile", "other").alias("s"), F.greatest("tile", "other").alias("t"), "tile", "key", "vector", "m")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        size, j = table["size"][0].as_py(), table["block"][0].as_py()
        x, y = table["x"][0].as_py(), table["y"][0].as_py()
        s, t = table["s"][0].as_py(), table["t"][0].as_py()
        of = Blocks(size, cosine)
        vectors = np.stack(_vectors(table["vector"].chunk(0) if table["vector"].num_chunks else table["vector"]))
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        turned = of.turned(vectors)
        tile, keys, many = table["tile"].to_numpy(), table["key"].to_pylist(), table["m"].to_numpy()
        left, right = np.flatnonzero(tile == s), np.flatnonzero(tile == t)
        a, b = of.parts[j]
        lowest = [np.floor(turned[:, axis] / of.cells[j]) for axis in of.axes(j)]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for begin in range(0, len(left), 256):
            rows = left[begin: begin + 256]
            block = turned[:, a:b]
            distance = ((block[rows] ** 2).sum(1)[:, None] + (block[right] ** 2).sum(1)[None]
                        - 2 * block[rows] @ block[right].T)
            near = distance <= of.budgets[j] + SLACK
            # a pair belongs to the cell of its lower corner
            for place, home in zip((x, y), lowest):
                near &= np.minimum(home[rows][:, None], home[right][None]) == place
            if s == t:
                near &= rows[:, None] < right[None]
            p, q = np.nonzero(near)
            p, q = rows[p], right[q]
            alike = np.einsum("ij,ij->i", unit[p], unit[q]) >= cosine
            p, q = p[alike], q[alike]
            mine = of.within(j, turned[p], turned[q])
            for earlier in range(j):
                mine &= ~of.within(earlier, turned[p], turned[q])
            found.append((p[mine], q[mine]))
        p, q = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(2))
        n = len(keys)
        linked = np.bincount(p, weights=many[q], minlength=n) + np.bincount(q, weights=many[p], minlength=n)
        low, own = _lowest_connected(n, p, q), np.flatnonzero(linked)
        return pa.table({
            "a": pa.array([keys[i] for i in own], pa.binary()),
            "b": pa.array([keys[low[i]] if low[i] != i else None for i in own], pa.binary()),
            "linked": pa.array(linked[own].astype(np.int64))})

    return meeting.groupBy(*cell, "s", "t").applyInArrow(run, "a binary, b binary, linked long")


def _key(label: Column, vector: Column) -> Column:
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(i), label, vector)), 16, "0") for i in range(2)]
    return F.unhex(F.concat(*halves))


def near_duplicates(embeddings: DataFrame, cosine: float = 0.93, id_column: str = "vec_id",
                    vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = embeddings.select(
        F.col(f"`{id_column}`").alias("vec_id"), F.col(f"`{vector_column}`").alias("vector"), F.col(f"`{label_column}`").alias("label"))
    keyed = rows.withColumn("key", F.when(usable(F.col("vector"), F.col("label")), _key(F.col("label"), F.col("vector"))))
    classes = stored(
        keyed.filter("key is not null").groupBy("key", "label", "vector").agg(F.count("*").alias("m"), F.min("vec_id").alias("low")),
        "vector-classes")
    found = stored(links(classes, cosine), "vector-links")
    partners = found.groupBy(F.col("a").alias("key")).agg(F.sum("linked").alias("linked"))
    members = classes.select("key", "m", "low").join(partners, "key", "left").join(
        components(found.filter("b is not null").select("a", "b")).withColumnRenamed("id", "key"), "key", "left").select(
        "key", (F.col("m") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "low",
        F.coalesce("component", "key").alias("component"))
    lowest = members.groupBy("component").agg(F.min("low").alias("component_id"))
    of_class = members.join(lowest, "component").select(F.col("key").alias("k"), "n_links", "component_id")
    joined = keyed.select("vec_id", "key").join(of_class, F.col("key") == F.col("k"), "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
