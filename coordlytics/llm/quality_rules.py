"""Quality rules: text statistics, fixed base rules and a learned decision list (operator 2, native).

The list is learned by sequential covering. A rule is a conjunction of thresholds on
statistics; it is grown condition by condition for the highest information gain on two thirds
of the labelled rows, pruned on the others, kept if it is precise there, and the rows it covers
are taken out before the next one. A condition has to save more bits than it takes to name it, which ends both
growing and covering; a rule that is not precise is dropped and what it covers set aside, so that it hides no other. The driver only ever sees counts per (statistic,
threshold), a fixed number. The result is an ordered list of Spark conditions.

Defined cases: a null or empty text has zero words and fails the base rules; null labels, labels
of unknown documents and labels without a document are ignored; contradictory labels of one id
count as bad; without labels of both classes the list is empty and keeps what the base keeps;
repeated rows are judged alike; input columns travel in a struct, so no name can clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordlytics.llm.store import scratch, stored

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SPAN = 5
#: Learned from at most about so many labelled rows, chosen by a hash of their id.
MAX_LABELLED = 200_000
THRESHOLDS = 24  # for each statistic
MIN_GAIN = 10.0  # bits: about what it takes to name one of all statistics, thresholds and directions
MIN_PRECISION = 0.9  # of a rule, on the rows it was not grown on
MIN_COVERED = 5

#: Statistics that rules may use, as SQL.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / n_words",
    "symbol_share": "n_symbols / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "distinct_share": "n_distinct / n_words",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # at least the threshold, else below it
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return F.coalesce(value >= self.threshold if self.above else value < self.threshold, F.lit(False))


Rule = tuple[Condition, ...]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all input columns as a struct) and the statistics of the whole text."""
    split = docs.select(
        F.struct("*").alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        F.array_remove(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), SPACE), "").alias("words"))
    hashed = split.select(
        "row", "text", F.size("words").alias("n_words"), F.char_length(F.array_join("words", "")).alias("word_chars"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    spans = F.transform(
        F.sequence(F.lit(0), F.col("n_words") - SPAN),
        lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(SPAN)]))
    spanned = hashed.select(
        "row", "text", "n_words", "word_chars", F.size(F.array_distinct("h")).alias("n_distinct"),
        F.when(F.col("n_words") > SPAN, spans).otherwise(F.array().cast("array<bigint>")).alias("spans"))
    # most texts repeat nothing; only the others are looked at position by position
    placed = F.array_sort(F.transform("spans", lambda s, i: F.struct(s.alias("s"), i.alias("i"))))
    ordered = spanned.select(
        "*", F.when(F.size(F.array_distinct("spans")) < F.size("spans"), placed).alias("placed"))
    twice = F.transform("placed", lambda x, j: F.when(
        (F.get("placed", j - 1)["s"] == x["s"]) | (F.get("placed", j + 1)["s"] == x["s"]), x["i"]))
    marked = ordered.select(
        "row", "text", "n_words", "word_chars", "n_distinct", F.array_sort(F.array_compact(twice)).alias("at"))
    covered = F.aggregate(
        F.col("at"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct(
            (acc["n"] + i + SPAN - F.greatest(acc["end"], i)).alias("n"), (i + SPAN).alias("end")))["n"]
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    lined = marked.select("row", "text", "n_words", "word_chars", "n_distinct", F.coalesce(covered, F.lit(0)).alias("n_repeat_words"), lines.alias("lines"))
    return lined.select(
        "row", F.col("n_words").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words").cast("long").alias("n_repeat_words"),
        F.col("n_distinct").cast("long").alias("n_distinct"), F.size("lines").cast("long").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def with_features(stats: DataFrame) -> DataFrame:
    """Adds the statistics the rules may use; shares of an empty text are null and meet no condition."""
    return stats.withColumns({
        f"f_{name}": F.when(F.col("n_words") > 0, F.expr(value)) for name, value in FEATURES.items()})


def _covers(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in rule], F.lit(True))


def _counts(rows: DataFrame, grids: dict[str, list[float]]) -> dict[str, dict[int, tuple[int, int]]]:
    """Bad and good rows per statistic and number of thresholds reached: one small aggregate."""
    places = F.array(*[
        F.struct(F.lit(name).alias("feature"), sum(((F.col(name) >= t).cast("int") for t in grid), F.lit(0)).alias("place"))
        for name, grid in grids.items()])
    held = rows.select("bad", F.explode(places).alias("p")).groupBy("p.feature", "p.place").agg(
        F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))
    out: dict[str, dict[int, tuple[int, int]]] = {name: {} for name in grids}
    for r in held.collect():  # at most statistics x (thresholds + 1) rows
        if r["place"] is not None:
            out[r["feature"]][r["place"]] = (r["bad"], r["good"])
    return out


def _gain(bad: int, good: int, all_bad: int, all_good: int) -> float:
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(all_bad / (all_bad + all_good)))


def _grow(rows: DataFrame, grids: dict[str, list[float]]) -> Rule:
    rule: Rule = ()
    while True:
        counts = _counts(rows.filter(_covers(rule)), grids)
        best, best_gain, pure = None, MIN_GAIN, False
        for name in sorted(grids):
            held, size = counts[name], len(grids[name])
            all_bad, all_good = sum(b for b, _ in held.values()), sum(g for _, g in held.values())
            if not all_bad or not all_good:
                pure = pure or bool(all_bad)
                continue
            for k in range(1, size + 1):
                bad = sum(b for place, (b, _) in held.items() if place >= k)
                good = sum(g for place, (_, g) in held.items() if place >= k)
                for above, b, g in ((True, bad, good), (False, all_bad - bad, all_good - good)):
                    gain = _gain(b, g, all_bad, all_good)
                    if gain > best_gain and b >= MIN_COVERED:
                        best, best_gain = Condition(name, above, grids[name][k - 1]), gain
        if pure or best is None:
            break
        rule = (*rule, best)
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, float, int]:
    """The beginning of ``rule`` that does best on unseen rows, its precision there and what it covers."""
    sums = [F.sum(F.when(_covers(rule[:k]), v).otherwise(0)) for k in range(1, len(rule) + 1) for v in (F.col("bad"), 1 - F.col("bad"))]
    found = [n or 0 for n in rows.agg(*[s.alias(f"n{i}") for i, s in enumerate(sums)]).first()]
    best = (rule, 0.0, 0, -2.0)
    for k in range(1, len(rule) + 1):
        bad, good = found[2 * k - 2: 2 * k]
        if bad + good and (worth := (bad - good) / (bad + good)) > best[3]:
            best = (rule[:k], bad / (bad + good), bad, worth)
    return best[:3]


def learn(stats: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """An ordered list of rules that reject. ``stats`` has doc_id and the statistics."""
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        (1 - F.min("quality")).alias("bad"))
    joined = with_features(stats).filter(~base_failed()).join(marks, "doc_id").withColumn(
        "draw", F.pmod(F.xxhash64(F.lit("quality"), F.col("doc_id")), F.lit(3_000_000)))
    names = [f"f_{name}" for name in FEATURES]
    rows = stored(joined.select("bad", "draw", *names), "quality-labelled")
    total = rows.count()
    if total > max_labelled:
        rows = rows.filter(F.col("draw") < int(3_000_000 * max_labelled / total))
    steps = [(i + 0.5) / THRESHOLDS for i in range(THRESHOLDS)]

    def grid(rows: DataFrame) -> dict[str, list[float]]:
        # thresholds at the quantiles of the bad rows, which are few, and of all
        found = rows.agg(*[F.percentile_approx(F.when(F.col("bad") == 1, F.col(n)), steps).alias(f"b{n}") for n in names],
                         *[F.percentile_approx(n, steps).alias(f"a{n}") for n in names]).first()
        return {n: g for n in names if (g := sorted({*(found[f"b{n}"] or []), *(found[f"a{n}"] or [])}))}

    rules: list[Rule] = []
    growing, unseen = rows.filter("draw % 3 <> 0"), rows.filter("draw % 3 = 0")
    while grids := grid(growing):
        grown = _grow(growing, grids)
        if not grown:
            break
        rule, precision, covered = _prune(unseen, grown)
        if precision >= MIN_PRECISION and covered >= MIN_COVERED:
            rules.append(rule)
            unseen = unseen.filter(~_covers(rule))
            growing = growing.filter(~_covers(rule))
        else:  # what a failed rule covers is set aside: it may hide other kinds
            growing = growing.filter(~_covers(grown))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """False at the first rule that applies, else true: nested conditional expressions, in order."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(_covers(rule), F.lit(False)).otherwise(out)
    return out


def judged(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``row`` (the given columns, all by default), the statistics, base_failed and kept of every document."""
    stats = statistics(docs)
    names = [c for c in stats.columns if c != "row"]
    if columns is None:
        with scratch(docs.sparkSession):
            rules = learn(stored(stats.select(F.col("row.doc_id").alias("doc_id"), *names), "quality-stats"), labels)
        # read again rather than stored with whole rows; as a generator's output, which no filter is pushed into
        read = stats.select("row", F.inline(F.array(F.struct(*names))))
    else:
        carried = F.struct(*[F.col(f"row.`{c}`").alias(c) for c in columns])
        read = stored(stats.select(F.col("row.doc_id").alias("doc_id"), carried.alias("row"), *names), "quality-stats")
        rules = learn(read.drop("row"), labels)
    return with_features(read).withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules))
