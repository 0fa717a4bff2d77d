"""The cheapest edits that make a sequence of turns a dialogue: grammar-compressed dynamic programming (operator 13).

A turn is one of nine symbols (its role's class, sound or truncated; or one that must go), a dialogue
is an optional system turn and then pairs of user and assistant turns. Each symbol is a min-plus transfer matrix over the four
states of that language; an entry is the least cost and the audit of edits that reaches it, the
ASCII-least one among equals. Symbols that often follow each other are replaced by rules (Re-Pair),
and a rule's matrix is the product of its two parts, computed once, bottom-up, and shared by all conversations. Audits are ropes:
a product joins two of them without copying, and letters are compared only where costs tie. Among audits of
equal cost between the same two states none is a beginning of another (it would have to end in insertions, which
cost), so the least of each part stays the least of the whole.

Nothing depends on how long a conversation is: turns are dealt by ranges of (conversation, turn), packed into chunks of at most
``CHUNK_TURNS``, and chunks are evaluated apart; a conversation is then a product over its chunks, streamed in
order with four running entries. Only its summary, and the digest of its text, pass through one task,
chunk by chunk: a digest has to see the whole text in order.

Defined cases: a null role or text is one space; a null conv_id is a conversation of its own, a null turn comes before all others; turns
of equal number are ordered by role and text; rows alike in everything are duplicates but for one; a role that is
empty or begins with another letter than s, u, a is never kept as it is; a conversation that loses all rows has zeros,
an empty audit and the digest of nothing; an empty table gives an empty result; of the input only conv_id, turn, role and text
are read, so no name can clash. A text of any length is one value in a chunk of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordlytics.llm.store import stored

CHUNK_TURNS, CHUNK_CHARS = 1024, 1 << 20
RULE_ROUNDS, RULES_A_ROUND = 12, 8
RULE_SYMBOL = 0xE000  # the first of the code points that name rules
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
SPACES = " \t\n\x0b\x0c\r"


# --- transfer matrices ----------------------------------------------------------------------------

class Rope:
    """Letters of an audit as a tree of parts; written out when first compared or asked for."""

    __slots__ = ("left", "right", "letters")

    def __init__(self, left=None, right=None, letters: str | None = None):
        self.left, self.right, self.letters = left, right, letters

    def text(self) -> str:
        if self.letters is None:
            parts, todo = [], [self]
            while todo:
                rope = todo.pop()
                if rope.letters is None:
                    todo += (rope.right, rope.left)
                else:
                    parts.append(rope.letters)
            self.letters, self.left, self.right = "".join(parts), None, None
        return self.letters


Entry = tuple[int, Rope]
Matrix = list[list["Entry | None"]]


def _least(a: Entry | None, b: Entry | None) -> Entry | None:
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if a[1].text() <= b[1].text() else b


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    for i in range(STATES):
        for k in range(STATES):
            first = a[i][k]
            if first is None:
                continue
            for j in range(STATES):
                second = b[k][j]
                if second is not None:
                    out[i][j] = _least(out[i][j], (first[0] + second[0], Rope(first[1], second[1])))
    return out


def _insertions() -> Matrix:
    """No, one or two insertions: more never help."""
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    for i in range(STATES):
        out[i][i] = (0, Rope(letters=""))
    for i, j in ((START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)):
        out[i][j] = (INSERT, Rope(letters="I"))
    for i in (START, SYSTEM):
        out[i][ASSISTANT] = (2 * INSERT, Rope(letters="II"))
    return out


def _edits(symbol: str) -> Matrix:
    """One turn: `x` has to go; s, u, a and o are sound turns by role; S, U, A and O truncated ones."""
    out: Matrix = [[None] * STATES for _ in range(STATES)]

    def offer(i, j, cost, letter):
        out[i][j] = _least(out[i][j], (cost, Rope(letters=letter)))

    kept = TRUNCATED if symbol.isupper() else 0
    for i in range(STATES):
        offer(i, i, DELETE, "D")
        if symbol == "x":
            continue
        following = ASSISTANT if i == USER else USER
        offer(i, following, kept + REROLE, "R")
        own = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(symbol.lower())
        if own == following or (own == SYSTEM and i == START):
            offer(i, own, kept + KEEP, "K")
    return out


@dataclass(frozen=True)
class Rule:
    name: str
    pair: str


class Evaluator:
    """Matrices of symbols, rules and packed sequences; every symbol includes what may be inserted behind it."""

    def __init__(self, rules: list[Rule]):
        behind = _insertions()
        self.known = {s: product(_edits(s), behind) for s in "xsuaoSUAO"}
        for rule in rules:
            self.known[rule.name] = product(self.known[rule.pair[0]], self.known[rule.pair[1]])

    def __call__(self, packed: str) -> Matrix:
        out = self.known[packed[0]]
        for symbol in packed[1:]:
            out = product(out, self.known[symbol])
        return out


# --- rules ----------------------------------------------------------------------------------------

def _packed(symbols: Column, rules: list[Rule]) -> Column:
    for rule in rules:
        symbols = F.replace(symbols, F.lit(rule.pair), F.lit(rule.name))
    return symbols


def grammar(sequences: DataFrame) -> list[Rule]:
    """Re-Pair over the column ``symbols`` of all rows: in each round the most frequent pairs become rules.

    Pairs of one round share no symbol, so that replacing one leaves the others' counts as they are.
    At most ``RULE_ROUNDS`` x ``RULES_A_ROUND`` rules, whatever the input; any set of rules gives the same results.
    """
    rules: list[Rule] = []
    for _ in range(RULE_ROUNDS):
        packed = sequences.select(_packed(F.col("symbols"), rules).alias("p")).filter(F.length("p") > 1)
        pairs = packed.select(F.explode(F.transform(
            F.sequence(F.lit(1), F.length("p") - 1), lambda i: F.substring(F.col("p"), i, F.lit(2)))).alias("pair"))
        counts = pairs.groupBy("pair").count().filter("count > 1").orderBy(F.desc("count"), "pair").limit(4 * RULES_A_ROUND)
        used: set[str] = set()
        for r in counts.collect():  # at most four times the rules of a round
            if len(used & set(r["pair"])) == 0 and len(used) < 2 * RULES_A_ROUND:
                used |= set(r["pair"])
                rules.append(Rule(chr(RULE_SYMBOL + len(rules)), r["pair"]))
        if not used:
            break
    return rules


def _evaluated(rules: list[Rule]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        matrix_of = Evaluator(rules)
        for batch in batches:
            costs, audits = [], []
            for packed in batch.column("packed").to_pylist():
                cells = [cell for row in matrix_of(packed) for cell in row]
                costs.append([None if c is None else c[0] for c in cells])
                audits.append([None if c is None else c[1].text() for c in cells])
            yield pa.RecordBatch.from_arrays(
                [batch.column("symbols"), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))],
                ["symbols", "costs", "audits"])

    return run


# --- turns to chunks ------------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """Turns as a faulty recorder would have left them, by a checksum of conversation and turn."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    body = text_of("text")
    return conversations.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(text_of("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(body, ".!?", "")).otherwise(body).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _marked(turns: DataFrame) -> DataFrame:
    """Each turn with its class, its own fault (blank or truncated) and a hash of what would repeat it."""
    ends = F.rtrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    return turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("class"),
        F.when(ends == "", "b").when(F.substring(ends, -1, 1).isin(".", "!", "?"), ".").otherwise("t").alias("fault"),
        F.unhex(F.md5(F.concat_ws("\x1f", F.md5("role"), "text"))).alias("key"))


CHUNK = ("range int, chunk long, first_turn long, last_turn long, turns long, classes string, faults string, keys array<binary>, "
         "roles array<string>, texts array<string>")


def _chunker(schema: pa.Schema, chunk_turns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted turns to chunks of one conversation each."""

    def run(batches):
        open_rows, chars, number = [], 0, 0
        done: list[dict] = []

        def close():
            nonlocal open_rows, chars, number
            turns = [r["turn"] for r in open_rows if r["turn"] is not None]
            done.append({
                "conv_id": open_rows[0]["conv_id"], "range": open_rows[0]["range"], "chunk": number,
                "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns)),
                "classes": "".join(r["class"] for r in open_rows), "faults": "".join(r["fault"] for r in open_rows),
                "keys": [r["key"] for r in open_rows], "roles": [r["role"] for r in open_rows], "texts": [r["text"] for r in open_rows]})
            open_rows, chars, number = [], 0, number + 1

        for batch in batches:
            for r in batch.to_pylist():
                if open_rows and (r["conv_id"] != open_rows[0]["conv_id"] or len(open_rows) >= chunk_turns or chars > CHUNK_CHARS):
                    close()
                open_rows.append(r)
                chars += len(r["text"])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done.clear()
        if open_rows:
            close()
            yield pa.RecordBatch.from_pylist(done, schema)

    return run


def _chunks(turns: DataFrame, chunk_turns: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"]
    dealt = _marked(turns).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    kind = turns.schema["conv_id"].dataType.simpleString()
    spark = turns.sparkSession
    schema = spark.createDataFrame([], f"conv_id {kind}, {CHUNK}").schema
    return dealt.mapInArrow(_chunker(to_arrow_schema(schema), chunk_turns), schema)


def _with_symbols(chunks: DataFrame) -> DataFrame:
    """The chunks' summaries with ``symbols``: repeated turns, blank ones and truncated ones are told apart."""
    places = chunks.select("conv_id", "range", "chunk", F.posexplode("keys").alias("pos", "key"))
    place = F.struct("range", "chunk", "pos")
    again = places.groupBy("conv_id", "key").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "first")
    repeats = places.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))).filter(place != F.col("first"))
    per_chunk = repeats.groupBy("range", "chunk").agg(F.collect_list("pos").alias("again"))  # at most CHUNK_TURNS
    known = chunks.select("conv_id", "range", "chunk", "first_turn", "last_turn", "turns", "classes", "faults").join(
        per_chunk, ["range", "chunk"], "left")

    def symbol(i: Column) -> Column:
        at = lambda c: F.substring(F.col(c), i + 1, F.lit(1))
        return (F.when(at("faults") == "b", F.lit("b")).when(F.array_contains("again", i), F.lit("d"))
                .when(at("faults") == "t", F.upper(at("classes"))).otherwise(at("classes")))

    marks = F.array_join(F.transform(F.sequence(F.lit(0), F.length("classes") - 1), symbol), "")
    count = lambda letters: F.length(F.regexp_replace("marks", f"[^{letters}]", ""))
    pairs = F.transform(F.sequence(F.lit(1), F.length("classes")), lambda i: F.substring(F.col("classes"), i, F.lit(2)))
    return known.withColumn("marks", marks).select(
        "conv_id", "range", "chunk", "first_turn", "last_turn", "turns", "classes",
        count("b").alias("blank"), count("d").alias("duplicate"), count("SUAO").alias("truncated"),
        F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin("su", "ua", "au"))).alias("illegal"),
        F.translate("marks", "bd", "xx").alias("symbols"))


# --- conversations --------------------------------------------------------------------------------

class _Run:
    """The running product of one conversation's chunks from the start.

    Each reachable state has its cost, the rank of its audit so far among the four, what its
    audit has more than the shorter one of equal rank that begins it, and the chunks' parts, linked backwards.
    """

    def __init__(self):
        self.entries = [None] * STATES
        for j, first in enumerate(_insertions()[START]):
            if first is not None:
                self.entries[j] = (first[0], 0, first[1].text(), None)
        self.began = False
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = None
        self.distinct, self.last_class, self.where = 0, None, []

    def take(self, r: dict) -> None:
        for name in self.sums:
            self.sums[name] += r[name]
        if self.last_class and self.last_class + r["classes"][0] not in ("su", "ua", "au"):
            self.sums["illegal"] += 1
        self.last_class = r["classes"][-1]
        if r["first_turn"] is not None:
            self.distinct += r["turns"] - (self.high == r["first_turn"])
            self.low = r["first_turn"] if self.low is None else self.low
            self.high = r["last_turn"]
        self.where.append((r["range"], r["chunk"]))
        found = [None] * STATES
        for i, entry in enumerate(self.entries):
            if entry is None:
                continue
            cost, rank, more, link = entry
            for j in range(STATES):
                extra, letters = r["costs"][STATES * i + j], r["audits"][STATES * i + j]
                if extra is None:
                    continue
                offer = (cost + extra, rank, more + letters, i, letters if self.began else more + letters)
                if found[j] is None or offer[:3] < found[j][0][:3]:
                    found[j] = (offer, link)
        ordered = sorted({f[0][1:3] for f in found if f})
        names, rank, head = {}, -1, None
        for key in ordered:
            if head is None or key[0] != head[0] or not key[1].startswith(head[1]):
                head, rank = key, rank + 1
            names[key] = (rank, key[1][len(head[1]):])
        self.entries = [
            None if f is None else (f[0][0], *names[f[0][1:3]], (f[1], f[0][3] if self.began else START, f[0][4])) for f in found]
        self.began = True

    def end(self) -> tuple[dict, list[tuple[int, int, int, str]]]:
        """The summary, and (range, chunk, state before it, its part of the audit) of every chunk."""
        ways = []
        for j in (START, ASSISTANT):
            if self.entries[j] is not None:
                cost, _, _, link = self.entries[j]
                parts = []
                while link is not None:
                    link, state, letters = link
                    parts.append((state, letters))
                parts.reverse()
                ways.append((cost, "".join(p for _, p in parts), parts))
        cost, audit, parts = min(ways, key=lambda w: w[:2])
        gaps = self.high - self.low + 1 - self.distinct if self.low is not None else 0
        return self.sums | {"gaps": gaps, "cost": cost, "audit": audit}, [(*w, *p) for w, p in zip(self.where, parts)]


def _folder(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        conv, current = None, None
        done: list[dict] = []

        def close():
            summary, parts = current.end()
            done.append({"conv_id": conv, "whole": True} | summary)
            done.extend({"conv_id": conv, "whole": False, "range": r, "chunk": c, "state": s, "audit": a} for r, c, s, a in parts)

        for batch in batches:
            for r in batch.to_pylist():
                if current is None or r["conv_id"] != conv:
                    if current is not None:
                        close()
                    conv, current = r["conv_id"], _Run()
                current.take(r)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done.clear()
        if current is not None:
            close()
            yield pa.RecordBatch.from_pylist(done, schema)

    return run


def repaired_turns(roles: list[str], texts: list[str], state: int, audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns that ``audit`` makes of these turns, entered in ``state``."""
    names = {USER: "user", ASSISTANT: "assistant"}
    at = 0
    for letter in audit:
        following = ASSISTANT if state == USER else USER
        if letter == "I":
            yield names[following], ""
            state = following
            continue
        role, text, at = roles[at], texts[at], at + 1
        if letter == "D":
            continue
        if letter == "R":
            role = names[following]
        state = SYSTEM if letter == "K" and role.startswith("s") else following
        yield role, text


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles, texts, states, audits = (batch.column(c).to_pylist() for c in ("roles", "texts", "state", "audit"))
        made = [list(repaired_turns(*r)) for r in zip(roles, texts, states, audits)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("range"), batch.column("chunk"),
             pa.array([[r for r, _ in m] for m in made], pa.list_(pa.string())),
             pa.array([[t for _, t in m] for m in made], pa.list_(pa.string()))], ["conv_id", "range", "chunk", "roles", "texts"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the lines of each conversation, whose chunks follow each other."""
    kind, done, conv, digest, empty = None, [], None, None, True
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for c, lines in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist()):
            if digest is None or c != conv:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest, empty = c, hashlib.sha256(), True
            if lines is not None:
                digest.update(lines.encode() if empty else b"\n" + lines.encode())
                empty = False
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([d for _, d in done])], ["conv_id", "digest"])
            done = []
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], ["conv_id", "digest"])


@dataclass
class Repaired:
    """``summary``: a row per conversation; ``turns``: the repaired turns, in the order of (range, chunk, place)."""

    summary: DataFrame
    turns: DataFrame


def repair(turns: DataFrame, chunk_turns: int = CHUNK_TURNS) -> Repaired:
    """Faults and the cheapest repair of every conversation in ``turns`` (conv_id, turn, role, text)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = turns.sparkSession
    kind = turns.schema["conv_id"].dataType.simpleString()
    chunks = stored(_chunks(turns, chunk_turns), "chunks")
    marked = stored(_with_symbols(chunks), "chunk-symbols")
    sequences = stored(marked.select("symbols").distinct(), "sequences")
    rules = grammar(sequences)
    matrices = sequences.select("symbols", _packed(F.col("symbols"), rules).alias("packed")).mapInArrow(
        _evaluated(rules), "symbols string, costs array<long>, audits array<string>")
    schema = spark.createDataFrame([], f"""conv_id {kind}, whole boolean, range int, chunk long, state int, gaps long, blank long,
        duplicate long, truncated long, illegal long, cost long, audit string""").schema
    place = ["conv_id", "range", "chunk"]
    folded = stored(
        marked.join(matrices, "symbols").repartition("conv_id").sortWithinPartitions(*place).mapInArrow(
            _folder(to_arrow_schema(schema)), schema), "folded")
    parts = folded.filter("not whole").select("range", "chunk", "state", "audit")
    applied = stored(
        chunks.select(*place, "roles", "texts").join(parts, ["range", "chunk"]).mapInArrow(
            _applied, f"conv_id {kind}, range int, chunk long, roles array<string>, texts array<string>"), "repaired")
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    digests = applied.select(*place, F.when(F.size("roles") > 0, lines).alias("lines")).repartition("conv_id").sortWithinPartitions(
        *place).mapInArrow(_digests, f"conv_id {kind}, digest string")
    summary = folded.filter("whole").join(
        digests.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("digest").alias("repaired_sha256"))
    made = applied.select(*place, F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "turn")).select(
        *place, "place", F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text"))
    return Repaired(summary, made)


def repaired_conversations(conversations: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """The summary of the damaged conversations' repair, with a row for every conv_id of the input."""
    found = repair(damaged(conversations), chunk_turns).summary.withColumnRenamed("conv_id", "c")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
