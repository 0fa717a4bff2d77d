"""Resampling documents by importance towards a target's distribution of hashed features (operator 11).

A text's features are its runs of neighbouring words, each put into a bucket by its CRC-32. How much more often
the target (here: the benchmark) holds a bucket than the documents do is that bucket's gain; a document
weighs the sum of its features' gains. Gumbel noise, drawn from a hash of the id, is added to the weight, so that
taking the highest scores is drawing without replacement in proportion to importance.

Checksums of all features of a batch are computed together (`crc.SpanCrc`): shares of (byte, distance from the end)
are looked up and XORed with `bitwise_xor.reduceat`; long features fold blockwise. Counts are summed per
task before they are shuffled; the gains are one number per bucket (``BUCKETS``, a parameter) and are the only thing that
every task gets. Texts are read twice, for the counts and for the weights, and never shuffled. Ranks come from a range
shuffle of (score, id) and a count per range: no task orders all documents.

Defined cases: a null text or one without words has no features and weighs 0; a null doc_id draws its noise from the empty
id and comes last among ties; rows alike in score and id are ranked in some order; an empty table gives an empty result, an
empty target leaves the gains to its smoothing; of the input only doc_id and text are read, so no name can
clash. A word of any length is hashed whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordlytics.llm.crc import SpanCrc
from coordlytics.llm.store import stored
from coordlytics.llm.words import text_slices

BUCKETS, LONGEST_RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
SPANS = 1 << 18  # features hashed at once


def _word_bytes() -> np.ndarray:
    """Digits, letters and everything beyond ASCII."""
    out = np.ones(256, bool)
    out[:0x80] = False
    for first, last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
        out[first: last + 1] = True
    return out


INSIDE = _word_bytes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): text d has words first[d]:first[d + 1]."""
    inside = INSIDE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = np.diff(offsets) > 0
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    begins[heads], ends[tails] = inside[heads], inside[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


class Features:
    """Buckets of the features of whole texts."""

    def __init__(self, buckets: int, longest: int):
        self.buckets, self.longest, self.crc = buckets, longest, SpanCrc()

    def read(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, words per row, row of each feature, bucket of each feature), in parts.

        The parts of one slice repeat its rows; their counts of words are given with the first of them.
        """
        for low, high, data, offsets in text_slices(texts):
            start, end, first = _words(data, offsets)
            counts = np.diff(first)
            data = LOWER[data]
            if self.longest > 1:
                data, start, end = self._joined(data, start, end)
            row = np.repeat(np.arange(high - low), counts)
            for n in range(1, self.longest + 1):
                heads = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1:]) if len(row) >= n else np.zeros(0, np.int64)
                for a in range(0, max(len(heads), 1), SPANS):
                    own = heads[a: a + SPANS]
                    found = self.crc.of(data, start[own], end[own + n - 1]) % np.uint32(self.buckets)
                    yield low, high, counts, row[own], found.astype(np.int64)
                    counts = np.zeros_like(counts)

    @staticmethod
    def _joined(data, start, end):
        """All words with one space between neighbours."""
        length = end - start
        ends = np.cumsum(length + 1) - 1
        out = np.full(int(length.sum()) + len(length), 0x20, np.uint8)
        inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[inside + np.repeat(ends - length, length)] = data[inside + np.repeat(start, length)]
        return out, ends - length, ends


def _counter(buckets: int, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        features, counts = Features(buckets, longest), np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, found in features.read(batch.column("text")):
                counts += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """(bucket, n): features of all texts by bucket."""
    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(
        _counter(buckets, longest), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket from the two tables of counts."""
    both = documents.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))).unionByName(
        documents.sparkSession.range(buckets).select(
            F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    each = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    all_s, all_t = each.agg(F.sum("s")).scalar(), each.agg(F.sum("t")).scalar()
    ratio = ((F.col("t") + 1) * (all_s + buckets)).cast("double") / ((F.col("s") + 1) * (all_t + buckets)).cast("double")
    return each.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def _weigher(gain: np.ndarray, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        features = Features(len(gain), longest)
        for batch in batches:
            n = batch.num_rows
            words, sizes, weights = (np.zeros(n, np.int64) for _ in range(3))
            for low, high, counts, row, found in features.read(batch.column("text")):
                words[low:high] += counts
                sizes[low:high] += np.bincount(row, minlength=high - low)
                weights[low:high] += np.bincount(row, weights=gain[found], minlength=high - low).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words), pa.array(sizes), pa.array(weights)],
                ["doc_id", "n_words", "n_features", "weight"])

    return run


def _noise(doc_id: Column, seed: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
              buckets: int = BUCKETS, longest: int = LONGEST_RUN, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; what is not drawn has no rank."""
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = [stored(bucket_counts(x, buckets, longest), "bucket-counts") for x in (read, target)]
    table = stored(gains(*counts, buckets), "gains")
    gain = np.zeros(buckets, np.int64)
    for r in table.collect():  # one number per bucket
        gain[r["bucket"]] = r["gain"]
    kind = read.schema["doc_id"].dataType.simpleString()
    weighed = stored(
        read.mapInArrow(_weigher(gain, longest), f"doc_id {kind}, n_words long, n_features long, weight long").select(
            "doc_id", "n_features", "weight", (F.col("weight") + _noise(F.col("doc_id"), seed)).alias("score"),
            (F.col("n_words") >= least_words).alias("eligible"), F.monotonically_increasing_id().alias("position")), "weighed")
    # ranges of the order, in which equal scores and ids are told apart by their place in the table
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("position")]
    ranges = stored(weighed.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n"), F.count_if("eligible").alias("ready"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = sizes.select(
        F.col("range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.expr(f"{percent} * sum(ready) over () div 100").alias("drawn"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranges.join(starts, F.col("range") == F.col("r")).withColumn("place", place).select(
        "doc_id", "n_features", "weight", "score",
        F.when(F.col("eligible") & (F.col("place") <= F.col("drawn")), F.col("place")).cast("long").alias("rank"))
