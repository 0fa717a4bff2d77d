"""Removal of word sequences that occur more than once (operator 5), by seed and extend.

Seeds: of every ``span`` consecutive words (a window) the smallest hash of its ``SEED``-word runs is
the anchor, so equal windows have equal anchors. Documents are joined on anchors that occur at least
twice anywhere; text around all others cannot repeat. Extension: around each such anchor all
windows that it stands for are taken, reaching as far to both sides as the anchor
reaches, and compared with the windows of the same anchor in all other places. The union of the
windows found again is the set of maximal repeats of at least ``span`` words.

Anchors and windows are only ever counted and joined, never paired. The windows of an anchor with many
places are dealt over several groups by their hash, and windows that repeat within a slice of texts are
settled there, so that a passage in any share of all documents fills no task. Equal texts are worked on
once. The texts are shuffled once; the three passes over them share that shuffle.

Defined cases: a null text counts as empty; texts shorter than a window lose nothing; copies of a text
of at least ``span`` words lose all words; null ids and repeated rows are documents like any other;
an empty table gives an empty result; names cannot clash, since input columns travel in a struct.
A single text must fit the memory of a task about a hundred times over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordlytics.llm.words import READ_BYTES, Reader, Words, mixed, text_slices

SEED = 8
PLACES = 512  # of an anchor, on average, in one group
LOW = np.uint64(0xFFFFFFFF)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have:]) if have < width else x


class Anchors:
    """For the windows of several texts: where each starts, its hash and the place and hash of its anchor."""

    def __init__(self, reader: Reader, words: Words, span: int, seed: int):
        empty = np.zeros(0, np.int64)
        self.start = self.place = empty
        self.hash = self.anchor = np.zeros(0, np.uint64)
        if len(words.hash) < span:
            return
        runs = reader.windows(words.hash, seed)
        # the leftmost of the smallest: positions break ties
        ranked = (runs & ~LOW) | np.arange(len(runs), dtype=np.uint64)
        place = (sliding_minimum(ranked, span - seed + 1) & LOW).astype(np.int64)
        inside = np.zeros(len(words.hash) + 1, np.int64)
        long = words.counts >= span
        np.add.at(inside, words.first[:-1][long], 1)
        np.add.at(inside, words.first[1:][long] - span + 1, -1)
        self.start = np.flatnonzero(np.cumsum(inside)[:-1])
        self.place = place[self.start]
        self.anchor = runs[self.place]
        self.hash = reader.windows(words.hash, span)[self.start]

    def cuts(self) -> np.ndarray:
        """Where a new anchor begins; windows of several texts never share one."""
        return np.flatnonzero(np.r_[True, self.place[1:] != self.place[:-1]]) if len(self.place) else self.start


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def anchors(texts: DataFrame, span: int, seed: int) -> DataFrame:
    """(h, tid) for every place of an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            tid = batch.column(0)
            for row, _, data, offsets in text_slices(batch.column(1), READ_BYTES):
                words = reader.read(data, offsets)
                found = Anchors(reader, words, span, seed)
                heads = found.cuts()
                doc = np.searchsorted(words.first, found.start[heads], "right") - 1 + row
                yield pa.RecordBatch.from_arrays([pa.array(_signed(found.anchor[heads])), tid.take(pa.array(doc))], ["h", "tid"])

    return texts.mapInArrow(run, "h long, tid binary")


def _grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal neighbours begin, and the offsets of an Arrow list with one entry per run."""
    heads = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return heads, np.r_[heads, len(values)].astype(np.int32)


def windows(texts: DataFrame, span: int, seed: int) -> DataFrame:
    """(h, part, tid, starts, w) per place of an anchor in ``hs``: where its windows start and their hashes.

    Windows of a crowded anchor are dealt over parts by their hash, so equal ones stay together. Windows that
    meet an equal one in the same slice of texts need not look further: they come in rows without ``w``, in
    parts of their own, and only one of each goes out to tell the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            tid, wanted = batch.column(0), batch.column(2)
            flat = wanted.flatten()
            limits = np.r_[0, np.cumsum(wanted.value_lengths().to_numpy())].astype(np.int64)
            names = flat.field("h").to_numpy().view(np.uint64)
            counts = flat.field("c").to_numpy()
            for row, _, data, offsets in text_slices(batch.column(1), READ_BYTES):
                words = reader.read(data, offsets)
                found = Anchors(reader, words, span, seed)
                if not len(found.start):
                    continue
                doc = np.searchsorted(words.first, found.start, "right") - 1
                parts = np.zeros(len(doc), np.int64)
                edges = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True])
                for a, b in zip(edges[:-1], edges[1:]):
                    d = row + int(doc[a])
                    own, much = names[limits[d]: limits[d + 1]], counts[limits[d]: limits[d + 1]]
                    order = np.argsort(own)
                    at = order[np.minimum(np.searchsorted(own, found.anchor[a:b], sorter=order), len(own) - 1)]
                    parts[a:b] = np.where(own[at] == found.anchor[a:b], -(-much[at] // PLACES), 0)
                hit = np.flatnonzero(parts)
                doc, parts, anchor, hashes = doc[hit], parts[hit], found.anchor[hit], found.hash[hit]
                start = (found.start[hit] - words.first[doc]).astype(np.int32)
                _, first, back, times = np.unique(
                    mixed(anchor + mixed(hashes)), return_index=True, return_inverse=True, return_counts=True)
                known = times[back] > 1
                out = ~known | (first[back] == np.arange(len(back)))
                places = found.place[hit]
                part = (hashes % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64)
                for chosen, shared in ((np.flatnonzero(out), True), (np.flatnonzero(known), False)):
                    if not shared:
                        part = -1 - (mixed(places.astype(np.uint64) + np.uint64(row)) % np.uint64(1024)).astype(np.int64)
                    chosen = chosen[np.lexsort((part[chosen], places[chosen]))]
                    heads, lists = _grouped(places[chosen] * (1 << 20) + part[chosen])
                    if not len(heads):
                        continue
                    ones = chosen[heads]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_signed(anchor[ones])), pa.array(part[ones].astype(np.int32)),
                         tid.take(pa.array(doc[ones] + row)), pa.ListArray.from_arrays(pa.array(lists), pa.array(start[chosen])),
                         pa.ListArray.from_arrays(pa.array(lists), pa.array(_signed(hashes[chosen]))) if shared
                         else pa.nulls(len(ones), pa.list_(pa.int64()))],
                        ["h", "part", "tid", "starts", "w"])

    return texts.mapInArrow(run, "h long, part int, tid binary, starts array<int>, w array<long>")


def cleaned(texts: DataFrame, span: int, give_text: bool) -> DataFrame:
    """Per text: n_words, n_removed, kept_sha256 and, if asked for, what is left of the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            starts, copied = batch.column(2), batch.column(3).to_pylist()
            n_words, n_removed, digests, left = [], [], [], []
            for row, stop, data, offsets in text_slices(batch.column(1), READ_BYTES):
                words = reader.read(data, offsets)
                for d in range(stop - row):
                    body = data[offsets[d]: offsets[d + 1]].tobytes()
                    own, n = body.split(), int(words.counts[d])
                    gone = np.zeros(n + 1, np.int32)
                    at = starts[row + d]
                    if at.is_valid:
                        at = np.unique(at.values.to_numpy())
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + span, -1)
                    lost = np.cumsum(gone)[:n] > 0
                    if copied[row + d] and n >= span:
                        lost[:] = True
                    removed = int(lost.sum())
                    kept = compress(own, (~lost).tolist()) if removed else own
                    n_words.append(n)
                    n_removed.append(removed)
                    digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    if give_text:
                        left.append(_without(body, words, d, int(offsets[d]), lost) if removed else body)
            out = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["tid", "n_words", "n_removed", "kept_sha256"]
            if give_text:
                out.append(pa.array(left, pa.binary()).cast(pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(out, names)

    more = ", text string" if give_text else ""
    return texts.mapInArrow(run, f"tid binary, n_words long, n_removed long, kept_sha256 string{more}")


def _without(body: bytes, words: Words, d: int, origin: int, lost: np.ndarray) -> bytes:
    """The text without the lost words and the white space behind each, other characters unchanged."""
    first, n = int(words.first[d]), len(lost)
    begin = words.start[first: first + n] - origin
    behind = np.r_[begin[1:], len(body)] if n else begin
    keep = np.zeros(len(body) + 1, np.int32)
    # bytes in front of the first word stay; then each kept word up to the next word
    keep[0] += 1
    if n:
        keep[begin[0]] -= 1
        np.add.at(keep, begin[~lost], 1)
        np.add.at(keep, behind[~lost], -1)
    mask = np.cumsum(keep)[:-1] > 0
    return np.frombuffer(body, np.uint8)[mask].tobytes()


def text_id(text: Column) -> Column:
    # never null, which the planner has to know: all passes then shuffle the texts by the very same plan
    return F.coalesce(F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")))), F.lit(bytearray()))


def without_repeats(docs: DataFrame, span: int = 35, seed: int = SEED, give_text: bool = False) -> DataFrame:
    """``row`` (all input columns but text), n_words, n_removed, kept_sha256 and, if asked for, the text that is left.

    A word goes if any window of ``span`` words that covers it starts anywhere else, in this or another
    document; windows are judged on the input.
    """
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), text_id(F.col("text")).alias("tid"))
    texts = docs.select(
        text_id(F.col("text")).alias("tid"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).dropDuplicates(["tid"])
    places = anchors(texts, span, seed)
    often = places.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1")
    wanted = places.join(often, "h").groupBy("tid").agg(F.collect_set(F.struct("h", "c")).alias("hs"))
    runs = windows(texts.join(wanted, "tid").select("tid", "text", "hs"), span, seed)
    dealt = runs.repartition("h", "part").select("h", "part", "tid", "w", F.posexplode("starts").alias("i", "start")).select(
        "h", "part", "tid", F.get("w", F.col("i")).alias("w"), "start")
    alike = dealt.selectExpr("tid", "start", "w", "count(*) over (partition by h, part, w) as n")
    starts = alike.filter("w is null or n > 1").groupBy("tid").agg(F.collect_list("start").alias("starts"))
    copied = named.groupBy("tid").agg(F.count("*").alias("c")).filter("c > 1").select("tid", F.lit(True).alias("copied"))
    known = texts.join(starts, "tid", "left").join(copied, "tid", "left").select("tid", "text", "starts", "copied")
    results = cleaned(known, span, give_text).withColumnRenamed("tid", "t")
    joined = named.join(results, F.col("tid") == F.col("t"))
    return joined.select("row", "n_words", "n_removed", "kept_sha256", *(["text"] if give_text else []))
