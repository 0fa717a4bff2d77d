"""Personal data and the words that give it away: information-theoretic sanitisation (operator 12).

Base spans (e-mail and IP addresses, card and phone numbers) are found by pattern and checked. Their values are the
protected entities. How strongly a word reveals an entity is estimated from the whole corpus: words within
``WINDOW`` words of a mention co-occur with it, and with n(c) mentions of the entity, n(t) occurrences of the
word, n(c, t) mentions near the word and M windows in the corpus, the word discloses

    log2(n(c, t) M / (n(c) n(t))) / log2(M / n(c))

of the entity's information: 1 if it is written next to that entity only, 0 if no more often than
anywhere. Words near a mention that disclose ``THRESHOLD`` or more, seen with it ``SUPPORT`` times at least, are
generalised to their first ``PREFIX`` letters if those disclose less, and removed otherwise. Spans of words never
overlap base spans, which stay as they are.

Everything is built-in functions: positions come from the lengths of what lies between the matches, summed in one pass; words are
counted before they are shuffled; only mentions, at most 2 x ``WINDOW`` words each, are joined, so no task holds
all words of an entity or all mentions of a word. Patterns never repeat a search over the same characters.

Defined cases: a null text is empty and has no spans; equal texts have equal spans; a null or repeated doc_id is a row
like any other; an empty table gives an empty result; of the input only doc_id and text are read unless the text is asked for,
then all columns travel in a struct, so no name can clash. A text of any length is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordlytics.llm.store import stored

WINDOW, CONTEXT_CHARS = 6, 160
SUPPORT, THRESHOLD, PREFIX = 3, 0.9, 3
RUN = 256  # entries that are appended to one by one
CUT = 4096  # code points of the pieces a text is rewritten from
KINDS = ["email", "ip", "card", "phone", "generalise", "remove"]
# Starts are tied to the beginning of a run of characters, or to the end of the match before, and
# repetitions are possessive: neither changes a match, both keep the search linear and free of recursion.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP_PARTS = rf"\A{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}\z"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN_TERMS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    plain = F.lower(value) if kind == "email" else value if kind == "ip" else _digits(value)
    return F.concat(F.lit(kind + ":"), plain)


def _located(text: Column, pattern: str) -> Column:
    """Matches in order: start, end (code points, end exclusive), value, the ends of the text before and behind it."""
    between = F.split(text, pattern, -1)
    parts = F.zip_with(
        F.zip_with(between, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda b, m: F.struct(
            F.length(b).alias("gap"), m.alias("value"), F.substring(b, -CONTEXT_CHARS, CONTEXT_CHARS).alias("before"))),
        F.slice(between, F.lit(2), F.size(between)),
        lambda x, after: F.struct(x["gap"].alias("gap"), x["value"].alias("value"), x["before"].alias("before"),
                                  F.substring(after, 1, CONTEXT_CHARS).alias("after")))
    one = "struct<start:int,end:int,value:string,before:string,after:string>"
    empty = F.array().cast(f"array<{one}>")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["before"].alias("before"),
                                x["after"].alias("after")))
        full = F.size(acc["last"]) >= RUN
        return F.struct(
            end.alias("at"), F.when(full, span).otherwise(F.concat(acc["last"], span)).alias("last"),
            F.when(full, F.concat(acc["runs"], F.array(acc["last"]))).otherwise(acc["runs"]).alias("runs"))

    begin = F.struct(F.lit(0).alias("at"), empty.alias("last"), F.array().cast(f"array<array<{one}>>").alias("runs"))
    found = F.filter(parts, lambda x: x["value"].isNotNull())
    return F.when(text.rlike(pattern), F.aggregate(
        found, begin, step, lambda acc: F.flatten(F.concat(acc["runs"], F.array(acc["last"]))))).otherwise(empty)


def _joined(spans: Column) -> Column:
    """kind:start:end of sorted (start, rank of kind, end), separated by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _base(docs: DataFrame, give_text: bool) -> DataFrame:
    """id, doc_id, the counts, ``base`` (sorted spans) and ``mentions`` of every row; with row and body if asked for."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select("doc_id", body.alias("body"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if give_text else []))

    def checked(kind: str) -> Column:
        return F.filter(_located(F.col("body"), PATTERNS[kind]), lambda x: _passes(kind, x["value"]))

    def span(i: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end")))

    def mention(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(
            _entity(kind, x["value"]).alias("entity"), x["start"].alias("start"), x["end"].alias("end"), x["before"].alias("before"),
            x["after"].alias("after")))

    found = read.withColumns({k: checked(k) for k in PATTERNS})
    spans, mentions = [span(i, k) for i, k in enumerate(PATTERNS)], [mention(k) for k in PATTERNS]
    return stored(found.select(
        F.monotonically_increasing_id().alias("id"), "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.array_sort(F.concat(*spans)).alias("base"), F.concat(*mentions).alias("mentions"),
        *(["row", "body"] if give_text else [])), "personal-data")


def _near(mentions: DataFrame) -> DataFrame:
    """Words around each mention: id, entity, term, start, end, and whether the word is the mention's first such."""
    located = mentions.withColumns({"b": _located(F.col("before"), TERM), "a": _located(F.col("after"), TERM)})
    at = F.col("start") - F.length("before")
    # what the edge of the context may have cut is no whole word
    b = F.filter("b", lambda x: (x["start"] > 0) | (F.length("before") < CONTEXT_CHARS))
    a = F.filter("a", lambda x: (x["end"] < CONTEXT_CHARS) | (F.length("after") < CONTEXT_CHARS))
    b = F.slice(F.reverse(b), 1, WINDOW)
    a = F.slice(a, 1, WINDOW)

    def placed(side: Column, base: Column) -> Column:
        return F.transform(side, lambda x: F.struct(
            F.lower(x["value"]).alias("term"), (x["start"] + base).alias("start"), (x["end"] + base).alias("end")))

    terms = F.concat(placed(b, at), placed(a, F.col("end")))
    listed = located.select("id", "entity", terms.alias("terms"))
    each = listed.select("id", "entity", F.posexplode("terms").alias("i", "t"), F.transform("terms", lambda x: x["term"]).alias("all"))
    return each.select("id", "entity", F.col("t.term").alias("term"), F.col("t.start").alias("start"), F.col("t.end").alias("end"),
                       (F.array_position("all", F.col("t.term")) == F.col("i") + 1).cast("long").alias("first"))


def _disclosed(both: str, entity: str, term: str) -> Column:
    """The share of an entity's information that a word gives."""
    windows = F.greatest(F.col("windows"), F.col(entity) + F.lit(1.0))
    together = F.least(F.col(both), F.col(term)).cast("double")
    return F.log2(together * windows / (F.col(entity) * F.col(term))) / F.log2(windows / F.col(entity))


def disclosing(mentions: DataFrame, near: DataFrame, vocabulary: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """(entity, term, kind) of the words to generalise or remove near each entity."""
    total = vocabulary.agg((F.coalesce(F.sum("n"), F.lit(0)) / (2 * WINDOW + 1)).alias("windows")).scalar()
    entities = mentions.groupBy("entity").agg(F.count("*").alias("n_entity"))
    pairs = near.groupBy("entity", "term").agg(F.sum("first").alias("n_both"))
    pairs = stored(pairs.filter(F.col("n_both") >= support).join(entities, "entity"), "pairs")
    risky = pairs.join(vocabulary.withColumnRenamed("n", "n_term"), "term").withColumn("windows", total)
    risky = risky.filter(_disclosed("n_both", "n_entity", "n_term") >= threshold).withColumn("prefix", F.substring("term", 1, PREFIX))
    heads = vocabulary.groupBy(F.substring("term", 1, PREFIX).alias("prefix")).agg(F.sum("n").alias("n_prefix"))
    together = pairs.groupBy("entity", F.substring("term", 1, PREFIX).alias("prefix")).agg(F.sum("n_both").alias("n_shared"))
    told = risky.join(heads, "prefix").join(together, ["entity", "prefix"])
    general = (F.length("term") > PREFIX) & (_disclosed("n_shared", "n_entity", "n_prefix") < threshold)
    return told.select("entity", "term", F.when(general, KINDS.index("generalise")).otherwise(KINDS.index("remove")).alias("kind"))


def _added(base: DataFrame, near: DataFrame, words: DataFrame) -> DataFrame:
    """(id, added): the sorted spans of disclosing words that touch no base span."""
    wanted = near.join(words, ["entity", "term"]).groupBy("id", "start", "end").agg(F.max("kind").alias("kind"))
    spans = base.select("id", F.explode("base").alias("s")).join(wanted.select("id").distinct(), "id", "left_semi")
    every = wanted.select("id", "start", "end", "kind").unionByName(
        spans.select("id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind")))
    is_base = F.col("kind") < len(PATTERNS)
    before = Window.partitionBy("id").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("id").orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    reach = every.withColumn("reach", F.max(F.when(is_base, F.col("end"))).over(before)).withColumn(
        "next", F.min(F.when(is_base, F.col("start"))).over(behind))
    free = reach.filter(~is_base & (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next"), F.col("end")) >= F.col("end")))
    return free.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))


def found(docs: DataFrame, give_text: bool = False, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the four counts, ``base`` and ``spans`` (sorted arrays of start, kind, end) of every row of ``docs``.

    With ``give_text`` also ``row``, all columns of the input, and ``body``, the text read.
    """
    base = _base(docs, give_text)
    text = docs.select(F.explode(F.split(F.lower(F.col("text").cast("string")), BETWEEN_TERMS, -1)).alias("term"))
    vocabulary = stored(text.filter("term <> ''").groupBy("term").agg(F.count("*").alias("n")), "vocabulary")
    mentions = base.select("id", F.explode("mentions").alias("m")).select("id", "m.*")
    near = stored(_near(mentions), "near-mentions")
    words = disclosing(mentions, near, vocabulary, support, threshold)
    added = _added(base, near, words).withColumnRenamed("id", "added_id")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return base.join(added, F.col("id") == F.col("added_id"), "left").select(
        "doc_id", *[f"n_{k}" for k in PATTERNS], "base", spans.alias("spans"), *(["row", "body"] if give_text else []))


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row."""
    return found(docs).select(
        "doc_id", *[f"n_{k}" for k in PATTERNS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``row`` (all columns) and ``text`` without what the spans mark: its kind in angle brackets, or a word's beginning and a star.

    Of overlapping spans the part behind the end of an earlier one is dropped with the later one's name.
    """
    read = found(docs, give_text=True).withColumn("cuts", F.regexp_extract_all("body", F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)))
    bounds = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    # each span with the furthest end before it; base spans of one kind are ordered, so this is a short scan over kinds
    ends = F.aggregate(bounds, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("last"), F.array().cast("array<array<int>>").alias("runs")),
                       lambda acc, s: F.struct(
                           F.greatest(acc["at"], s["end"]).alias("at"),
                           F.when(F.size(acc["last"]) >= RUN, F.array(acc["at"])).otherwise(F.concat(acc["last"], F.array(acc["at"]))).alias("last"),
                           F.when(F.size(acc["last"]) >= RUN, F.concat(acc["runs"], F.array(acc["last"]))).otherwise(acc["runs"]).alias("runs")),
                       lambda acc: F.flatten(F.concat(acc["runs"], F.array(acc["last"]))))
    rows = read.withColumn("ends", ends).withColumn("size", F.length("body"))

    def between(a: Column, b: Column) -> Column:
        i, j = F.floor(a / CUT).cast("int"), F.floor(b / CUT).cast("int")
        first = F.substring(F.coalesce(F.get("cuts", i), F.lit("")), (a % CUT + 1).cast("int"), (F.when(i == j, b - a).otherwise(CUT)).cast("int"))
        whole = F.when(j > i + 1, F.array_join(F.slice("cuts", i + 2, j - i - 1), "")).otherwise(F.lit(""))
        last = F.when(j > i, F.substring(F.coalesce(F.get("cuts", j), F.lit("")), F.lit(1), (b % CUT).cast("int"))).otherwise(F.lit(""))
        return F.concat(first, whole, last)

    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    parts = F.zip_with("spans", "ends", lambda s, end: F.concat(
        F.when(s["start"] > end, between(end, s["start"])).otherwise(F.lit("")),
        F.when(s["kind"] == KINDS.index("generalise"), F.concat(between(s["start"], s["start"] + PREFIX), F.lit("*")))
        .when(s["end"] > end, F.get(names, s["kind"])).otherwise(F.lit(""))))
    tail = F.greatest(F.array_max(F.transform("spans", lambda s: s["end"])), F.lit(0))
    return rows.select("row", F.concat(F.array_join(parts, ""), between(F.coalesce(tail, F.lit(0)), F.col("size"))).alias("text"))
