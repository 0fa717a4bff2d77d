"""Operators 11 to 13 against plain loops: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from coordlytics.llm import dialogue_repair, disclosure, importance
from coordlytics.llm.crc import SpanCrc

DOCS = "doc_id long, text string, `bucket` int, `n` string, `row` string, `base` int, `id` int, `term` string"
CLASH = (1, "n", "r", 2, 3, "t")


def table(spark, texts, repeats=()):
    rows = [(None if i == 3 else i, t, *CLASH) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[i] for i in repeats], DOCS), [(r[0], r[1]) for r in rows + [rows[i] for i in repeats]]


# --- 11 -------------------------------------------------------------------------------------------

def test_checksums_of_spans():
    rng = random.Random(4)
    data = np.frombuffer(rng.randbytes(300_000), np.uint8)
    sizes = [*range(70), 127, 128, 129, 192, 193, 4095, 4096, 4097, 65537, 299_999]
    start = np.array([rng.randrange(len(data) - n + 1) for n in sizes])
    end = start + np.array(sizes)
    assert SpanCrc().of(data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end)]
    assert len(SpanCrc().of(data, start[:0], end[:0])) == 0


def resampled(rows, target, buckets, longest, least, percent, seed):
    def features(text):
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        runs = [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    own = [features(t) for _, t in rows]
    s = Counter(b for _, f in own for b in f)
    t = Counter(b for x in target for b in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for (d, _), (n, f) in zip(rows, own):
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        out.append([d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    ready = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = percent * len(ready) // 100
    ranks = {id(r): i + 1 for i, r in enumerate(ready[:drawn])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=repr)


@pytest.mark.parametrize("longest,buckets", [(1, 97), (3, 1000)])
def test_importance_resampling(spark, longest, buckets):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Élan", "ÀÉ", "x-y", "A1b", "日本", "\x00"]
    texts = [rng.choice([" ", "\n", ", "]).join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    texts += ["", None, " .,; ", "a" * 500, "b" * 200_000 + " b", " ".join(rng.choice(words) for _ in range(9000)), "w1 " * 30, "w1 " * 30]
    docs, rows = table(spark, texts, repeats=(0, 0, 84))
    target = texts[:9] + [None]
    aimed = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resampled(docs, aimed, percent=40, least_words=5, buckets=buckets, longest=longest, seed=7).collect()
    assert sorted(map(tuple, got), key=repr) == resampled(rows, target, buckets, longest, 5, 40, 7)
    nothing = aimed.limit(0)
    assert importance.resampled(docs.limit(0), aimed).count() == 0
    assert {r["rank"] for r in importance.resampled(docs, nothing, percent=0).collect()} == {None}


# --- 12 -------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else 0,
            "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def sanitising(texts, support, threshold):
    """(base spans, all spans) per text."""
    base, mentions, words = [], [], Counter()
    for i, text in enumerate(texts):
        text = text or ""
        words.update(w.lower() for w in re.findall(disclosure.TERM, text))
        spans = []
        for k, (kind, pattern) in enumerate(PATTERNS.items()):
            every = list(re.finditer(pattern, text))
            bounds = [0, *[m.end() for m in every]], [*[m.start() for m in every], len(text)]
            for j, m in enumerate(every):
                if not passes(kind, m.group()):
                    continue
                spans.append((m.start(), k, m.end()))
                value = m.group().lower() if kind == "email" else m.group() if kind == "ip" else re.sub("[^0-9]", "", m.group())
                low, high = max(bounds[0][j], m.start() - 160), min(bounds[1][j + 1], m.end() + 160)
                before = [(w.start() + low, w.end() + low, w.group()) for w in re.finditer(disclosure.TERM, text[low:m.start()])
                          if w.start() > 0 or m.start() - low < 160]
                after = [(w.start() + m.end(), w.end() + m.end(), w.group()) for w in re.finditer(disclosure.TERM, text[m.end():high])
                         if w.end() < 160 or high - m.end() < 160]
                mentions.append((i, f"{kind}:{value}", before[::-1][:6] + after[:6]))
        base.append(sorted(spans))
    entities = Counter(m[1] for m in mentions)
    both = Counter((e, w) for _, e, near in mentions for w in {t.lower() for *_, t in near})
    prefixes = Counter()
    for w, n in words.items():
        prefixes[w[:3]] += n
    shared = Counter()
    for (e, w), n in both.items():
        if n >= support:
            shared[e, w[:3]] += n
    windows = words.total() / 13

    def told(n, e, t):
        m = max(windows, entities[e] + 1)
        return math.log2(min(n, t) * m / (entities[e] * t)) / math.log2(m / entities[e])

    out = [set(b) for b in base]
    chosen = {}
    for i, e, near in mentions:
        for a, b, w in near:
            low = w.lower()
            if both[e, low] >= support and told(both[e, low], e, words[low]) >= threshold:
                general = len(low) > 3 and told(shared[e, low[:3]], e, prefixes[low[:3]]) < threshold
                chosen[i, a, b] = max(chosen.get((i, a, b), 0), 4 if general else 5)
    for (i, a, b), kind in chosen.items():
        if all(b <= x or y <= a for x, _, y in base[i]):
            out[i].add((a, kind, b))
    name = lambda spans: ",".join(f"{disclosure.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return [(name(b), name(s)) for b, s in zip(base, out)]


def private_texts():
    rng = random.Random(6)
    words = [f"word{i}" for i in range(50)] + ["été", "日本語", "naïve", "Ünder"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [say(rng.randint(5, 60)) for _ in range(60)]
    for i in range(14):
        texts.append(f"{say(9)} the Quaxolot keeper of Wordz{i} ann.lee@mail.example.org {say(3)} zyx{i % 2} {say(12)}")
        texts.append(f"{say(4)} call +1 (555) 010-99{i % 3}7 zebracorn {say(40)}")
    texts += [
        "a@b.c_d@e.f.g a@b a@b. @x.y q@w-e.r..t %+-@1.2", "1.2.3.4.5.6.7.8.9 256.1.1.1 0001.2.3.0255 1.2.3 1..2.3.4.5 9.9.9.9x",
        "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112 411111111111111 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 12  34",
        "+1 2 +44 (0) 20 7946 0958. ++12345678901+ +1..........2 +123456789012345 +1234567890123456 +1-",
        "日本 ann.lee@mail.example.org été 10.0.0.1 naïve", "a@" + "b." * 3000 + "c", "x" * 20_000, "1" * 15_000, "1 " * 15_000,
        "+" + "1 (" * 5000, "9." * 9000, "u@v.w " * 700 + "end", "", None, " \n\t", "ann.lee@mail.example.org", "ann.lee@mail.example.org"]
    return texts


def test_personal_data(spark):
    texts = private_texts()
    docs, rows = table(spark, texts, repeats=(62, 62, 61))
    for support, threshold in ((2, 0.5),):
        want = sanitising([t for _, t in rows], support, threshold)
        got = disclosure.found(docs, support=support, threshold=threshold).select(
            "doc_id", *[f"n_{k}" for k in PATTERNS], disclosure._joined(disclosure.F.col("base")).alias("base"),
            disclosure._joined(disclosure.F.col("spans")).alias("spans")).collect()
        counts = [[b.count(k + ":") for k in PATTERNS] for b, _ in want]
        assert sorted(map(tuple, got), key=repr) == sorted(((d, *c, *w) for (d, _), c, w in zip(rows, counts, want)), key=repr)
    assert any("remove" in s for _, s in want) and any("generalise" in s for _, s in want)


def test_personal_data_query_columns(spark):
    docs, rows = table(spark, ["mail x@y.zz now", None])
    got = {r["doc_id"]: tuple(r)[1:] for r in disclosure.spans_of(docs).collect()}
    assert got == {0: (1, 0, 0, 0, hashlib.sha256(b"email:5:11").hexdigest(), "email:5:11"), 1: (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")}
    assert disclosure.spans_of(docs.limit(0)).count() == 0


def test_sanitised_text(spark):
    texts = private_texts()
    docs, rows = table(spark, texts)
    spans = {(r["doc_id"]): (r["body"], r["spans"]) for r in disclosure.found(docs, give_text=True).collect()}
    for r in disclosure.sanitised(docs).collect():
        body, own = spans[r["row"]["doc_id"]]
        out, at = "", 0
        for s in own:
            out += body[at:s["start"]]
            if s["kind"] == 4:
                out += body[s["start"]:s["start"] + 3] + "*"
            elif s["end"] > at:
                out += f"<{disclosure.KINDS[s['kind']].upper()}>"
            at = max(at, s["end"])
        assert r["text"] == out + body[at:]


# --- 13 -------------------------------------------------------------------------------------------

def repaired(turns):
    """One conversation's summary, by the plain programme over whole strings."""
    turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    spaces, seen, marks = " \t\n\x0b\x0c\r", set(), []
    for _, role, text in turns:
        body = text.rstrip(spaces)
        marks.append("b" if not body else "d" if (role, text) in seen else "." if body[-1] in ".!?" else "t")
        seen.add((role, text))
    insert = {0: [(2, "I")], 1: [(2, "I")], 2: [(3, "I")], 3: [(2, "I")]}

    def offer(best, state, way):
        if state not in best or way < best[state]:
            best[state] = way

    def closed(best):
        for _ in range(2):
            for s, (cost, audit) in list(best.items()):
                for to, letter in insert[s]:
                    offer(best, to, (cost + 5, audit + letter))
        return best

    best = closed({0: (0, "")})
    for (_, role, _), mark in zip(turns, marks):
        after = {}
        for s, (cost, audit) in best.items():
            offer(after, s, (cost + 2, audit + "D"))
            if mark not in "bd":
                more = 5 if mark == "t" else 0
                following = 3 if s == 2 else 2
                offer(after, following, (cost + more + 1, audit + "R"))
                own = {"s": 1, "u": 2, "a": 3}.get(role[:1])
                if own == following or (own == 1 and s == 0):
                    offer(after, own, (cost + more, audit + "K"))
        best = closed(after)
    cost, audit = min(best[s] for s in (0, 3) if s in best)
    state, i, lines = 0, 0, []
    for letter in audit:
        following = 3 if state == 2 else 2
        if letter == "D":
            i += 1
            continue
        name = {2: "user", 3: "assistant"}[following]
        if letter == "I":
            lines.append(name + ":")
        else:
            lines.append((turns[i][1] if letter == "K" else name) + ":" + turns[i][2])
            i += 1
        state = 1 if letter == "K" and lines[-1][0] == "s" else following
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    known = {t for t, *_ in turns if t is not None}
    initials = "".join(r[1][:1] if r[1][:1] in ("s", "u", "a") else "o" for r in turns)
    return (max(known) - min(known) + 1 - len(known) if known else 0, marks.count("b"), marks.count("d"), marks.count("t"),
            sum(initials[i:i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1)), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def conversations():
    rng = random.Random(8)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "usr"]
    bodies = ["Yes.", "no", " ", "", None, "What?\n", "ok!", "fin. \t", "same text.", "日本。", "a\nb."]
    rows = []
    for c in range(150):
        n = rng.choice([1, 2, 3, 5, 8, 30])
        for t in range(n):
            tidy = rng.random() < 0.6
            role = ("user", "assistant")[t % 2] if tidy else rng.choice(roles)
            text = f"turn {t} of {c}." if tidy else rng.choice(bodies)
            rows.append((c if c != 7 else None, rng.choice([t, t, t, t + 1, None, 3 * t]), role, text))
    for t in range(5000):  # a long one, faulty throughout
        rows.append((1000, t if t % 9 else None, rng.choice(roles[:4]), rng.choice(["same text.", f"t{t}.", f"t{t}", " ", "x" * rng.randint(0, 50) + "."])))
    rows += [(1001, 5, "user", "one."), (1001, 5, "user", "one."), (1001, 5, "user", "one."), (1001, -4, "assistant", "y" * 200_000)]
    rows += [(1002, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(2500)]
    return rows


def test_conversation_repair(spark, monkeypatch):
    rows = conversations()
    frame = spark.createDataFrame([(*r, "k", 1, "s") for r in rows], "conv_id long, turn long, role string, text string, key string, `range` int, symbols string")
    want = sorted(((c, *repaired(t)) for c, t in damaged(rows).items()), key=repr)
    assert sorted(map(tuple, dialogue_repair.repaired_conversations(frame).collect()), key=repr) == want
    monkeypatch.setattr(dialogue_repair, "RULE_ROUNDS", 0)
    many = dialogue_repair.repaired_conversations(frame.repartition(3), chunk_turns=7)  # many chunks and no rules give the same
    assert sorted(map(tuple, many.collect()), key=repr) == want


def test_conversation_repair_gives_turns(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "hi."), (1, 1, "assistant", "well."), (2, 0, "user", " ")], "conv_id long, turn long, role string, text string")
    made = dialogue_repair.repair(turns).turns.orderBy("conv_id", "range", "chunk", "place").select("conv_id", "role", "text").collect()
    assert [tuple(r) for r in made] == [(1, "user", "hi."), (1, "assistant", "well.")]


def test_conversation_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert dialogue_repair.repaired_conversations(none).count() == 0
