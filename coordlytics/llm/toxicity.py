"""Toxicity by class-conditional Kneser-Ney models (operator 6).

Two bigram models, of toxic and of ordinary texts, are interpolated Kneser-Ney: a pair's discounted count,
else the pair's count over both classes, weighed by how many different words its word follows within the
class, and at last in both. What is rare thus falls back to shared counts and speaks for neither class. Counts are numbers of documents, so a text that repeats itself does not weigh more. A word's
evidence is the difference of its two log-likelihoods; a text is described by its mean evidence and by the
highest mean over few neighbouring words, by its length, and a logistic curve fitted on other labelled rows turns
that into a score.

Fitted on at most `MAX_ROWS` labelled rows and `MAX_BYTES` of text per class for the models and as many rows for the curve, drawn by a
hash of the id; labels of held-out ids are never read. Scoring reads every whole text. Counts are made by Spark, also of
what a single document has; what scoring needs of a unit, a hash and two small counts, is bounded by the bytes
read (no unit is shorter than a byte and its separator) and comes to the driver in `PARTS` slices of the hash.

Defined cases: a null or empty text has no words and gets the score of no evidence; null labels and labels
without a document are ignored, contradictory ones count as toxic; without both classes in either
draw all scores are 0; a null doc_id is never held out; repeated rows get equal scores; an
empty table gives an empty result; of the input only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordlytics.llm.store import stored
from coordlytics.llm.words import Reader, Words, mixed, text_slices

MAX_ROWS, MAX_BYTES = 5_000, 16 << 20  # of the sample, per class
PARTS = 8  # in which counts are fetched
STEMS = (4, 5, 6, 7, 8)  # bytes of the beginnings of words
NEAR = 1  # neighbouring words that are judged together
THRESHOLD = 0.3
RARE_SHARE = 0.01  # of the toxic documents: the number in which any word is assumed to occur in either class
RARE_CONTEXT = 10.0  # documents in which a context is assumed to follow the shared counts


def letters() -> np.ndarray:
    """Everything but letters, digits and bytes beyond ASCII separates words."""
    out = np.ones(256, bool)
    out[128:] = out[48:58] = out[65:91] = out[97:123] = False
    return out


def reader() -> Reader:
    return Reader(separators=letters(), fold=True, seed=6)


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + word)


def preceding(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word before each, 0 at the beginning of a text."""
    out = np.zeros_like(hashes)
    out[1:] = hashes[:-1]
    out[first[:-1][np.diff(first) > 0]] = 0
    return out


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


@dataclass
class Level:
    """What one level of backoff needs of its counts."""

    total: tuple[float, float]
    kinds: tuple[float, float]
    discount: tuple[float, float]

    def likelihoods(self, counts: np.ndarray, lean: list[np.ndarray], rare: float) -> list[np.ndarray]:
        """Of both classes; ``lean`` is what the level below says of each class, 1 on average."""
        shared = (counts[:, 0] + counts[:, 1] + 1) / (sum(self.total) + sum(self.kinds) + 1)
        weight = max(d * k / f for d, k, f in zip(self.discount, self.kinds, self.total))
        out = []
        for c in range(2):
            kept = max(1.0, self.total[c] - self.discount[c] * self.kinds[c])
            known = np.maximum(counts[:, c] - self.discount[c], 0) / kept
            out.append((1 - weight) * known + (weight * shared + rare / self.total[0]) * lean[c])
        return out


def leaning(likelihoods: list[np.ndarray]) -> list[np.ndarray]:
    middle = (likelihoods[0] + likelihoods[1]) / 2
    return [x / middle for x in likelihoods]


@dataclass
class Models:
    words: np.ndarray  # sorted
    of_word: np.ndarray  # rows: follow_t, follow_o, seen_t, kinds_t, seen_o, kinds_o
    pairs: np.ndarray  # sorted
    of_pair: np.ndarray  # rows: n_t, n_o
    stems: np.ndarray  # sorted
    of_stem: np.ndarray  # rows: n_t, n_o
    pair_discount: float
    word_level: Level
    stem_levels: list[Level]
    rare: float  # documents in which any word is assumed to occur in either class besides

    def evidence(self, own: Reader, words: Words) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of every word."""
        hashes, first = words.hash, words.first
        if not len(hashes):
            return np.zeros(0)
        lean = [np.ones(len(hashes))] * 2
        for width, level in zip(STEMS, self.stem_levels):
            counts = _found(self.stems, self.of_stem, own.beginnings(words, width))
            lean = leaning(level.likelihoods(counts, lean, self.rare))
        traits = _found(self.words, self.of_word, hashes)
        before = preceding(hashes, first)
        context = np.zeros_like(traits)
        context[1:] = traits[:-1]
        heads = first[:-1][np.diff(first) > 0]
        context[heads] = _found(self.words, self.of_word, np.zeros(1, np.uint64))
        counts = _found(self.pairs, self.of_pair, pair_key(before, hashes))
        own_c = self.word_level.likelihoods(traits[:, :2], lean, self.rare)
        scale = self.word_level.total[0] / self.word_level.total[1]  # of ordinary counts to the size of the toxic ones
        middle = (own_c[0] + own_c[1]) / 2
        d = self.pair_discount
        # pairs over both classes
        seen, kinds = context[:, 2] + context[:, 4], context[:, 3] + context[:, 5]
        both = np.where(seen > 0, (np.maximum(counts.sum(axis=1) - d, 0) + d * kinds * middle) / np.maximum(seen, 1), middle)
        seen = context[:, 2] + scale * context[:, 4]
        backoff = (d * (context[:, 3] + scale * context[:, 5]) + RARE_CONTEXT) / (seen + RARE_CONTEXT)
        logs = []
        for c in range(2):
            kept = context[:, 2 + 2 * c] - d * context[:, 3 + 2 * c]
            known = np.where(kept > 0, np.maximum(counts[:, c] - d, 0) / np.maximum(kept, 1e-9), 0)
            # what the class does not know falls back to the shared pairs, weighed by what the class says of the word
            logs.append(np.log((1 - backoff) * known + backoff * both * own_c[c] / middle))
        return logs[0] - logs[1]


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros((len(wanted), values.shape[1]))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    out = values[at].astype(np.float64)
    out[keys[at] != wanted] = 0
    return out


def traits_of(evidence: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: highest mean over NEAR words, mean, and log of the number of words."""
    n = np.diff(first)
    out = np.zeros((len(n), 3))
    sums = np.r_[0.0, np.cumsum(evidence)]
    full = n > 0
    out[full, 1] = (sums[first[1:]] - sums[first[:-1]])[full] / n[full]
    out[:, 2] = np.log1p(n)
    short = full & (n < NEAR)
    out[short, 0] = (sums[first[1:]] - sums[first[:-1]])[short] / NEAR
    long = np.flatnonzero(n >= NEAR)
    if len(long):
        near = (sums[NEAR:] - sums[:-NEAR]) / NEAR
        cuts = np.stack([first[:-1][long], first[1:][long] - NEAR + 1], 1).reshape(-1)
        out[long, 0] = np.maximum.reduceat(np.r_[near, -np.inf], cuts)[::2]
    return out


def _units(texts: DataFrame, stems: bool) -> DataFrame:
    """(toxic, before, word): each pair of a text once; or (toxic, before = width, word = stem): each stem once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reader()
        for batch in batches:
            marks = batch.column(0).to_numpy()
            for row, stop, data, offsets in text_slices(batch.column(1)):
                words = own.read(data, offsets)
                doc = np.repeat(np.arange(row, stop), words.counts)
                if stems:
                    units = [(np.full(len(doc), w, np.uint64), own.beginnings(words, w)) for w in STEMS]
                else:
                    units = [(preceding(words.hash, words.first), words.hash)]
                for before, word in units:
                    _, at = np.unique(pair_key(pair_key(before, word), doc.astype(np.uint64)), return_index=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(marks[doc[at]]), pa.array(before[at].view(np.int64)), pa.array(word[at].view(np.int64))],
                        ["toxic", "before", "word"])

    counted = texts.select("toxic", "text").mapInArrow(run, "toxic int, before long, word long")
    return counted.groupBy("before", "word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))


def _discount(once: float, twice: float) -> float:
    return once / (once + 2 * twice) if once else 0.5


def count_models(texts: DataFrame, rare_share: float = RARE_SHARE) -> Models:
    """``texts``: toxic (0 or 1) and text of a bounded number of rows and bytes. Counted by Spark; all counts, also of what
    one text has, come to the driver, 16 bytes a unit."""
    pairs = stored(_units(texts, False), "toxic-pairs")
    stems = stored(_units(texts, True), "toxic-stems")
    seen = lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0))
    contexts = pairs.groupBy(F.col("before").alias("w")).agg(
        F.sum("t").alias("seen_t"), seen("t").alias("kinds_t"), F.sum("o").alias("seen_o"), seen("o").alias("kinds_o"))
    follow = pairs.groupBy(F.col("word").alias("w")).agg(seen("t").alias("follow_t"), seen("o").alias("follow_o"))
    names = ["follow_t", "follow_o", "seen_t", "kinds_t", "seen_o", "kinds_o"]
    words = stored(follow.join(contexts, "w", "full").fillna(0).select("w", *names), "toxic-words")
    at = lambda c, n: F.count(F.when(F.col(c) == n, 1))
    p = pairs.agg(at("t", 1).alias("t"), at("o", 1).alias("o"), at("t", 2).alias("tt"), at("o", 2).alias("oo")).first()

    def level(counts: DataFrame, t: str, o: str) -> list[Level]:
        found = counts.groupBy("before").agg(*[
            x.alias(f"{c}{i}") for c, n in (("t", t), ("o", o))
            for i, x in enumerate((F.sum(n), F.count(F.when(F.col(n) > 0, 1)), at(n, 1), at(n, 2)))]).orderBy("before").collect()
        return [Level(
            (max(1, r["t0"]), max(1, r["o0"])), (r["t1"], r["o1"]), (_discount(r["t2"], r["t3"]), _discount(r["o2"], r["o3"])))
            for r in found]

    none = Level((1, 1), (0, 0), (0.5, 0.5))
    word_level = level(words.withColumn("before", F.lit(0)), "follow_t", "follow_o") or [none]
    stem_levels = level(stems, "t", "o") or [none] * len(STEMS)
    hashed = pairs.select("before", "word", "t", "o").mapInArrow(_with_keys, "key long, t int, o int")
    word_keys, of_word = _sorted_counts(words.withColumnRenamed("w", "key"), names)
    pair_keys, of_pair = _sorted_counts(stored(hashed, "toxic-pair-keys"), ["t", "o"])
    stem_keys, of_stem = _sorted_counts(stems.select(F.col("word").alias("key"), "t", "o"), ["t", "o"])
    return Models(
        word_keys, of_word, pair_keys, of_pair, stem_keys, of_stem,
        _discount(p["t"] + p["o"], p["tt"] + p["oo"]), word_level[0], stem_levels,
        1 + rare_share * texts.filter("toxic = 1").count())


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        before, word = (batch.column(c).to_numpy().view(np.uint64) for c in ("before", "word"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(pair_key(before, word).view(np.int64)), batch.column("t").cast(pa.int32()), batch.column("o").cast(pa.int32())], ["key", "t", "o"])


def _sorted_counts(table: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and their counts, fetched slice by slice of the key, so that the driver never holds a second copy of all."""
    width = (1 << 64) // PARTS
    keys, counts = [], []
    for part in range(PARTS):
        low = part * width - (1 << 63)
        own = table.filter(F.col("key").between(low, low + width - 1)).select("key", *[F.col(n).cast("int").alias(n) for n in names]).toArrow()
        # hashes are compared as unsigned numbers
        found = own["key"].to_numpy().view(np.uint64)
        order = np.argsort(found)
        keys.append(found[order])
        counts.append(np.stack([own[n].to_numpy().astype(np.float32)[order] for n in names], 1))
    half = PARTS // 2  # negative numbers are the upper half
    return np.concatenate(keys[half:] + keys[:half]), np.concatenate(counts[half:] + counts[:half])


def fit_curve(traits: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a little shrinkage, by Newton steps."""
    x = np.c_[np.ones(len(traits)), traits]
    beta = np.zeros(x.shape[1])
    shrink = np.diag([0.0, *[1e-3] * traits.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - toxic)) + shrink @ beta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + shrink + 1e-9 * np.eye(len(beta))
        step = np.linalg.solve(bend, slope)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _draw(labels: DataFrame, docs: DataFrame, model: bool, max_rows: int) -> DataFrame:
    """(toxic, text) of at most ``max_rows`` rows per class; the ids drawn, 2 x ``max_rows``, are sent everywhere."""
    chosen = labels.filter(F.col("fold").isin(0, 1) if model else F.col("fold") == 3)
    ids = [chosen.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for c in (0, 1)]
    drawn = ids[0].unionByName(ids[1]).select("doc_id", "toxic")
    return docs.join(F.broadcast(drawn), "doc_id").dropDuplicates(["toxic", "text"])


def _within(texts: DataFrame, max_bytes: int) -> DataFrame:
    """Whole texts per class in a repeatable order until ``max_bytes`` are reached; the first stays whatever its size.

    ``texts`` is a bounded sample; only lengths are ordered.
    """
    order = Window.partitionBy("toxic").orderBy("place", "text_md5").rowsBetween(Window.unboundedPreceding, -1)
    sized = texts.withColumns({"place": F.xxhash64("text"), "text_md5": F.coalesce(F.md5("text"), F.lit("")), "size": F.coalesce(F.octet_length("text"), F.lit(0))})
    lengths = sized.select("toxic", "place", "text_md5", "size").withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    kept = lengths.filter(F.col("before") < max_bytes).select("toxic", "place", "text_md5")
    return sized.join(kept, ["toxic", "place", "text_md5"]).select("toxic", "text")


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    marks = stored(
        labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("fold", fold_of(F.col("doc_id"))).filter("fold <> 2"), "toxic-labels")
    share = marks.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    texts = stored(_draw(marks, chosen, True, max_rows).withColumn("model", F.lit(True)).unionByName(
        _draw(marks, chosen, False, max_rows).withColumn("model", F.lit(False))), "toxic-texts")
    models = count_models(stored(_within(texts.filter("model"), max_bytes), "toxic-sample"))
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(models)

    def traits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reader()
        for batch in batches:
            for row, stop, data, offsets in text_slices(batch.column(1)):
                words = own.read(data, offsets)
                found = traits_of(shared.value.evidence(own, words), words.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, stop - row), *[pa.array(found[:, i]) for i in range(3)]], ["k", "x", "y", "z"])

    other = texts.filter("not model").select("toxic", "text").mapInArrow(
        traits, "k int, x double, y double, z double").toArrow()  # at most 2 x max_rows rows
    toxic = other["k"].to_numpy().astype(float)
    beta = None
    if len(toxic) and 0 < toxic.sum() < len(toxic):
        even = np.where(toxic == 1, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
        beta = fit_curve(np.stack([other[c].to_numpy() for c in "xyz"], 1), toxic, even)
    id_type = chosen.schema["doc_id"].dataType.simpleString()
    scored = chosen.mapInArrow(traits, f"k {id_type}, x double, y double, z double")
    if beta is None:
        score = F.lit(0.0)
    else:
        line = F.lit(float(beta[0])) + sum(F.col(c) * float(b) for c, b in zip("xyz", beta[1:]))
        score = 1 / (1 + F.exp(-line))
    return scored.select(
        F.col("k").alias("doc_id"), F.coalesce(fold_of(F.col("k")) == 2, F.lit(False)).alias("held_out"), score.alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
