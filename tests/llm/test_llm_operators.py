"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from coordlytics.llm import (
    embeddings, graph, minhash, mixing, prefilter, prefix, quality_rules, repeats, sentencepiece_codec, sharding, token_counts, toxicity,
    url_filter)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `size` string, `row` int, `key` string"
WORDS = [f"w{i}" for i in range(400)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(12, 90)) for _ in range(n)]
    passage = sentence(rng, 55)
    texts += [sentence(rng, 10) + " " + passage + "\n" + sentence(rng, 9) for _ in range(4)]
    base = sentence(rng, 100).split()
    for k in range(12):
        near = list(base)
        for p in rng.sample(range(100), k % 4):
            near[p] = "changed%d" % rng.randint(0, 9)
        texts.append(" ".join(near))
    texts += [texts[0], texts[0], texts[0].upper(), "", "", None, " \t\n ", "one two", "one two", "One\x0bTwo", "x " * 50,
              "the same line of words\n" * 9, "###*** $$$ %%% &&& |||", sentence(rng, 6000), "é" * 5000, "a\u00a0b c\x85d"]
    return texts


def frame(spark, texts, schema=DOCS):
    sources = ["a", "b", None, "ä", "B"]
    rows = [(None if i == 3 else i, t, "en", sources[i % 5] if i % 3 else "a", 0, "s", i, "k") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[-1]]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# --- helpers ------------------------------------------------------------------------------------

def test_running_totals(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), "id", prefix.shuffled_key(F.col("id")).alias("key"), F.lit(2).alias("v"))
    got = prefix.running(df, ["g"], "key", ["id"], "v", "upto").collect()
    for g in range(3):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: (r["key"], r["id"]))
        assert [r["upto"] for r in own] == [2 * (i + 1) for i in range(len(own))]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(64)] + [(500, 500)]
    want = brute.components(600, links)
    got = dict(rows(graph.components(spark.createDataFrame(links + [(7, None)], "a long, b long")), "id", "component"))
    assert got == {i: want[i] for i in {x for a, b in links if a != b for x in (a, b)}}


def test_components_without_links(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 ------------------------------------------------------------------------------------------

def fair_queue(sized, most=3):
    """{row position: words taken} and {source: target} by a loop over all documents in order of finish time."""
    import hashlib

    names = sorted({s for _, s, _ in sized if s is not None}) + ([None] if any(s is None for _, s, _ in sized) else [])
    total = {s: sum(n for _, x, n in sized if x == s) for s in names}
    weight = {s: float(i % 3 + 1) for i, s in enumerate(names)}
    target, open_, left = {}, list(names), float(sum(total.values()))
    while open_:
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > most * total[s]]
        if not over:
            target.update({s: left * weight[s] / sum(weight[x] for x in open_) for s in open_})
            break
        for s in over:
            target[s] = float(most * total[s])
            left -= target[s]
        open_ = [s for s in open_ if s not in over]
    items = []
    for s in names:
        own = sorted(
            ((hashlib.md5(("mix\x1f" + ("\x00" if d is None else str(d))).encode()).hexdigest(), str(d), n, i)
             for i, (d, x, n) in enumerate(sized) if x == s))
        upto = 0
        for *_, n, i in own:
            upto += n
            items += [((upto + t * total[s]) / weight[s], names.index(s), n, i) for t in range(most) if n]
    taken, used = [0] * len(sized), 0
    for _, _, n, i in sorted(items):
        used += n
        if used > sum(total.values()):
            break
        taken[i] += n
    return taken, target


def test_mix_is_the_fair_queue(docs):
    table = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
    sized = [(d, s, len(brute.words(t))) for d, s, t in table]
    taken, target = fair_queue(sized)
    want = sorted(((d, n, target[s], k) for (d, s, n), k in zip(sized, taken)), key=repr)
    got = sorted(rows(mixing.shares(docs), "doc_id", "size", "target", "taken"), key=repr)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_mixed_documents_repeat(docs):
    shares = {}
    for d, size, taken in rows(mixing.shares(docs), "doc_id", "size", "taken"):
        shares[d] = shares.get(d, 0) + (taken // size if size else 0)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts = dict(rows(mixed.groupBy("doc_id").count(), "doc_id", "count"))
    assert counts == {d: n for d, n in shares.items() if n}


def test_mix_of_nothing(spark, none):
    assert mixing.shares(none).count() == 0
    empty = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert sorted(rows(mixing.shares(empty), "doc_id", "target", "taken")) == [(1, 0.0, 0), (2, 0.0, 0)]


# --- 2 ------------------------------------------------------------------------------------------

def test_statistics(docs):
    got = rows(quality_rules.statistics(docs), "row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert len(got) == docs.count()
    for text, *found in got:
        assert tuple(found) == brute.statistics(text), text


def test_rules_are_learned(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        own = sentence(rng, 40).split()
        texts.append((i, " ".join(w + "$$" if bad else w for w in own)))
        labels.append((i, 0 if bad else 1))
    labels += [(None, 0), (3, None), (9999, 0), (1, 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    judged = quality_rules.judged(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = dict(rows(judged, "row.doc_id", "kept"))
    assert kept == {i: i % 5 != 0 for i in range(600)}


def test_verdict_is_an_ordered_list(spark):
    rules = [(quality_rules.Condition("x", True, 5.0), quality_rules.Condition("y", False, 2.0)), (quality_rules.Condition("y", True, 9.0),)]
    df = spark.createDataFrame([(6.0, 1.0), (6.0, 3.0), (1.0, 9.0), (None, None)], "x double, y double")
    assert [r[0] for r in rows(df, quality_rules.verdict(rules))] == [False, True, False, True]


def test_quality_without_labels(docs, none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules.judged(docs, labels)
    assert got.filter("kept = base_failed").count() == 0
    assert quality_rules.judged(none, labels).count() == 0


def test_ten_kinds_of_junk_give_ten_rules(spark):
    rng = random.Random(21)
    table = []

    def add(bad, words=None, length=None, symbols=None, dup=None, repeat=None, distinct=None):
        n = int(words or rng.uniform(60, 900))
        share = lambda x, low, high: n * (rng.uniform(low, high) if x is None else rng.uniform(*x))
        table.append((bad, n, int(share(length, 4.0, 6.0)), int(share(symbols, 0.0, 0.05)), int(100 * (rng.uniform(*dup) if dup else rng.uniform(0, 0.2))),
                      int(share(repeat, 0.0, 0.05)), int(share(distinct, 0.5, 0.8)), 100))

    kinds = [
        dict(words=5000), dict(words=14), dict(length=(12, 20)), dict(length=(1.0, 2.0)), dict(symbols=(0.5, 0.9)), dict(symbols=(0.2, 0.3)),
        dict(dup=(0.8, 0.99)), dict(dup=(0.4, 0.5)), dict(repeat=(0.12, 0.19)), dict(distinct=(0.05, 0.2))]
    for kind in kinds:
        for _ in range(150):
            add(1, **kind)
    for _ in range(2500):
        add(0)
    for _ in range(600):  # ordinary texts beyond two of the kinds: those are bands, not tails
        add(0, symbols=(0.36, 0.44))
        add(0, dup=(0.56, 0.7))
    rng.shuffle(table)
    stats = spark.createDataFrame(
        [(i, *r[1:]) for i, r in enumerate(table)],
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_distinct long, n_lines long")
    labels = spark.createDataFrame([(i, 1 - r[0]) for i, r in enumerate(table)], "doc_id long, quality int")
    rules = quality_rules.learn(stats, labels)
    assert len(rules) >= 10
    judged = quality_rules.with_features(stats).select("doc_id", quality_rules.verdict(rules).alias("kept")).collect()
    bad = [r["kept"] for r in judged if table[r["doc_id"]][0]]
    good = [r["kept"] for r in judged if not table[r["doc_id"]][0]]
    assert sum(bad) <= 0.03 * len(bad) and sum(good) >= 0.98 * len(good)


# --- 3 and 8 ------------------------------------------------------------------------------------

ODD = ["", " ", "  a", "a  b", "a \n b", "a<|endoftext|> b <|endoftext|>", "\t a  b", "x\x1c y", "a'll 's  's", "<s> a", "▁▁ ▁",
       "a                    b", "日本語 😀😀 x", "ab\u3000c\u00a0ﬁ"]


def fuzz(n, alphabet):
    rng = random.Random(8)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = corpus() + ODD + fuzz(300, [" ", " ", "\n", "ab", "B", "1", "é", "<|endoftext|>", "'s", "!", "\x1c", "\u3000"])
    df = frame(spark, texts)
    library = Tokenizer.from_file(path)
    for text, n_bytes, n_tokens, over in rows(
            token_counts.token_counts(df.withColumn("doc_id", F.col("text")), path, limit=20), "doc_id", "n_bytes", "n_tokens", "over_limit"):
        want = len(library.encode(text or "", add_special_tokens=False))
        assert (n_bytes, n_tokens, over) == (len((text or "").encode()), want, want > 20)
    assert token_counts.token_counts(df.limit(0), path).count() == 0


def test_pieces_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = corpus() + ODD + fuzz(500, "ab  \nethrsin.,1é日😀ßñ▁'A")
    df = frame(spark, texts)
    coded = sentencepiece_codec.coded(df, path, ["text"])
    for text, ids, n in rows(coded, "row.text", "ids", "n_tokens"):
        assert ids == library.encode(text or "") and n == len(ids)
        if "▁" not in (text or ""):
            assert sentencepiece_codec.model(path).decode(sentencepiece_codec.np.array(ids)) == (text or "")
    assert coded.filter("not round_trip and text is not null and not contains(text, '▁')".replace("text", "row.text")).count() == 0
    assert sentencepiece_codec.coded(df.limit(0), path, ["doc_id"]).count() == 0


def test_unigram_pieces_have_the_best_score():
    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -4.0, 1), ("▁a", -3.2, 1), ("ba", -4.1, 1),
              ("aba", -5.0, 1), ("bb", -9.0, 1)]
    model = sentencepiece_codec.Model(pieces, sentencepiece_codec.UNIGRAM)
    score = {p: s for p, s, k in pieces if k == 1}

    def best(text):
        if not text:
            return 0.0
        found = [score[text[:k]] + best(text[k:]) for k in range(1, 4) if text[:k] in score]
        return max([*found, model.lowest + best(text[1:]) if text[0] not in score else -1e9])

    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("aabbc ") for _ in range(rng.randint(1, 9)))
        got = model.by_score(model.prepared(text))
        if "c" not in text:
            assert sum(pieces[i][1] for i in got) == pytest.approx(best(model.prepared(text)))
            assert model.decode(sentencepiece_codec.np.array(got)) == text
    assert model.by_score("▁cca") == [1, 0, 2]


# --- 4 ------------------------------------------------------------------------------------------

def test_shards(spark, none):
    import zlib

    texts = corpus() + ["the same"] * 70 + [None] * 3
    df = frame(spark, texts)
    got = sharding.sharded(df, 7).select("row.*", F.col("size").alias("bytes"), "text_crc32", "shard", "slot").drop("size").collect()
    n = df.count()
    assert len(got) == n
    by = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(7)}
    assert all(slots == list(range(len(slots))) for slots in by.values())
    assert {len(slots) for slots in by.values()} <= {n // 7, n // 7 + 1}
    groups = {}
    for r in got:
        body = (r["text"] or "").encode()
        assert r["bytes"] == len(body) + 1 and r["text_crc32"] == zlib.crc32(body)
        if r["text"] is not None:
            groups.setdefault(r["text"], []).append(r["shard"])
    quota = -(-n // 7)
    cut = {t: len(set(s)) for t, s in groups.items() if len(set(s)) > 1}
    assert len(cut) <= 2 and cut["the same"] == -(-groups["the same"].__len__() // quota) + 1 or cut["the same"] == -(-len(groups["the same"]) // quota)
    again = sharding.sharded(df, 7).select("row.doc_id", "shard").collect()
    assert sorted(map(repr, again)) == sorted(repr(type(again[0])(doc_id=r["doc_id"], shard=r["shard"])) for r in got)
    assert sharding.sharded(none, 7).count() == 0


def test_shards_recount_votes_and_keep_neighbours_together(spark):
    """A graph of cliques joined by single links, against recounts in plain Python."""
    rng = random.Random(13)
    size, cliques, shards = 6, 20, 4
    links = [(c * size + i, c * size + j) for c in range(cliques) for i in range(size) for j in range(i)]
    links += [(c * size, c * size + size) for c in range(cliques - 1)]
    members = spark.createDataFrame([(d, f"{a}-{b}") for a, b in links for d in (a, b)], "doc long, hub string")
    start = [d % shards for d in range(size * cliques)]
    rng.shuffle(start)
    labels = spark.createDataFrame(list(enumerate(start)), "doc long, shard int")
    quota = [size * cliques // shards + 4] * shards

    def cut(of):
        return sum(of[a] != of[b] for a, b in links)

    votes = {r["hub"]: r["votes"] for r in sharding.votes_of(members, labels, shards).collect()}
    assert votes == {f"{a}-{b}": [(start[a] == s) + (start[b] == s) for s in range(shards)] for a, b in links}
    done = sharding.propagate(members, labels, quota)
    after = {r["doc"]: r["shard"] for r in done.labels.collect()}
    assert done.cuts[0] == cut(dict(enumerate(start))) and min(done.cuts) == cut(after)
    assert len(set(done.cuts)) > 2  # later rounds count the shards that the earlier ones led to
    assert cut(after) <= 0.35 * cut(dict(enumerate(start)))
    assert sorted(after) == list(range(size * cliques)) and max(list(after.values()).count(s) for s in range(shards)) <= quota[0]


def test_grants_keep_quotas():
    rng = random.Random(14)
    for _ in range(200):
        n = rng.randint(2, 6)
        room = [rng.randint(0, 9) for _ in range(n)]
        flows = {(s, t): rng.randint(1, 20) for s in range(n) for t in range(n) if s != t and rng.random() < 0.6}
        got = sharding.grants(flows, room)
        assert all(0 <= got[k] <= flows[k] for k in flows)
        for t in range(n):
            assert sum(v for (_, to), v in got.items() if to == t) - sum(v for (s, _), v in got.items() if s == t) <= room[t]


def test_shards_with_links_of_the_caller(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(64)] + [(None, None)], "doc_id long, text string")
    members = spark.createDataFrame([(i, i // 4) for i in range(40)] + [(99, 1), (None, 2), (50, 77)], "doc_id long, group long")
    got = {r["doc_id"]: r["shard"] for r in sharding.sharded(docs, 4, members=members).select("row.doc_id", "shard").collect()}
    assert sorted(list(got.values()).count(s) for s in range(4)) == [16, 16, 16, 17]
    assert sum(len({got[i] for i in range(g * 4, g * 4 + 4)}) == 1 for g in range(10)) >= 8


# --- 5 ------------------------------------------------------------------------------------------

@pytest.mark.parametrize("span", [8, 12, 35])
def test_repeats(spark, docs, span):
    table = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = sorted(((d, *w[:3]) for (d, _), w in zip(table, brute.without_repeats([t for _, t in table], span))), key=repr)
    got = repeats.without_repeats(docs, span, give_text=True)
    assert sorted(rows(got, "row.doc_id", "n_words", "n_removed", "kept_sha256"), key=repr) == want
    for text, digest in rows(got, "text", "kept_sha256"):
        import hashlib
        assert hashlib.sha256(" ".join(brute.words(text)).encode()).hexdigest() == digest


def test_repeats_of_a_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PLACES", 3)
    rng = random.Random(6)
    common = sentence(rng, 20)
    texts = [sentence(rng, rng.randint(0, 9)) + " " + common + " " + sentence(rng, 6) for _ in range(40)]
    texts += [t + " tail" for t in texts[:9]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(rows(repeats.without_repeats(df, 22), "row.doc_id", "n_words", "n_removed", "kept_sha256"))
    assert got == [(i, *w[:3]) for i, w in enumerate(brute.without_repeats(texts, 22))]


def test_repeats_keep_other_characters(spark):
    body = "b c d e f g h i j k"
    df = spark.createDataFrame([(1, f"  a\t{body}\n z "), (2, f"{body} y")], "doc_id long, text string")
    assert sorted(rows(repeats.without_repeats(df, 9, give_text=True), "text")) == [("  a\tz ",), ("y",)]


def test_repeats_of_nothing(none):
    assert repeats.without_repeats(none, 35).count() == 0


# --- 6 ------------------------------------------------------------------------------------------

def test_toxicity(spark, none):
    rng = random.Random(7)
    texts, labels = [], []
    for i in range(1200):
        own = sentence(rng, rng.randint(10, 60)).split()
        if i % 6 == 0:
            for _ in range(3):
                own.insert(rng.randint(0, len(own)), rng.choice(["vile", "foul"]) + rng.choice(["ish", "er", "", "est"]))
        texts.append((i, " ".join(own), "vile"))
        labels.append((i, int(i % 6 == 0)))
    texts += [(None, None, ""), (5000, "", ""), (7, texts[7][1], "")]
    labels += [(None, 1), (8, None), (99999, 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = rows(toxicity.toxicity(docs, marks), "doc_id", "held_out", "score", "predicted")
    assert len(got) == len(texts)
    import zlib
    assert all(h == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2) for d, h, _, _ in got)
    assert all(0 <= s <= 1 and p == (s >= 0.3) for _, _, s, p in got)
    held = [(d % 6 == 0, p) for d, h, _, p in got if h and d < 1200]
    assert sum(t and p for t, p in held) >= 0.9 * sum(t for t, _ in held)
    assert sum(p and not t for t, p in held) <= 0.03 * len(held)
    # labels of held-out documents change nothing
    flipped = spark.createDataFrame(
        [(d, 1 - t if d is not None and t is not None and zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, t in labels],
        "doc_id long, toxic int")
    assert sorted(got, key=repr) == sorted(rows(toxicity.toxicity(docs, flipped), "doc_id", "held_out", "score", "predicted"), key=repr)
    assert toxicity.toxicity(none, marks).count() == 0
    assert {r[0] for r in rows(toxicity.toxicity(docs, marks.limit(0)), "score")} == {0.0}


def plain_kneser_ney(labelled, docs):
    """Features of every text of ``docs`` by dictionaries of strings."""
    import math
    import re
    from collections import Counter, defaultdict

    split = lambda t: [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))]
    pairs, stems = Counter(), {w: Counter() for w in toxicity.STEMS}
    for toxic, text in set(labelled):
        words = split(text)
        pairs.update((p, toxic) for p in set(zip([b"", *words], words)))
        for width, counts in stems.items():
            counts.update((s, toxic) for s in {w[:width] for w in words})

    def discount(counts):
        once, twice = (sum(n == k for n in counts) for k in (1, 2))
        return once / (once + 2 * twice) if once else 0.5

    def level(counts):
        of = [[n for (_, c), n in counts.items() if c == k] for k in (1, 0)]
        return [max(1, sum(x)) for x in of], [len(x) for x in of], [discount(x) for x in of]

    rare = 1 + toxicity.RARE_SHARE * len({t for c, t in labelled if c})
    follow, seen, kinds = Counter(), Counter(), Counter()
    for (pair, c), n in pairs.items():
        follow[pair[1], c] += 1
        seen[pair[0], c] += n
        kinds[pair[0], c] += 1

    def likelihoods(of_level, t, o, lean):
        total, kind, d = of_level
        shared = (t + o + 1) / (sum(total) + sum(kind) + 1)
        weight = max(d[k] * kind[k] / total[k] for k in (0, 1))
        return [(1 - weight) * max(n - d[k], 0) / max(1, total[k] - d[k] * kind[k]) + (weight * shared + rare / total[0]) * lean[k]
                for k, n in ((0, t), (1, o))]

    levels, words_level = {w: level(c) for w, c in stems.items()}, level(follow)
    d = discount(list(pairs.values()))
    scale = words_level[0][0] / words_level[0][1]

    def evidence(before, word):
        lean = [1, 1]
        for width, counts in stems.items():
            got = likelihoods(levels[width], counts[word[:width], 1], counts[word[:width], 0], lean)
            lean = [x / (sum(got) / 2) for x in got]
        own = likelihoods(words_level, follow[word, 1], follow[word, 0], lean)
        n = [pairs[(before, word), 1], pairs[(before, word), 0]]
        if not any(n):
            return math.log(own[0] / own[1]), math.log(own[0] / own[1])
        s, k, middle = [seen[before, 1], seen[before, 0]], [kinds[before, 1], kinds[before, 0]], sum(own) / 2
        both = (max(sum(n) - d, 0) + d * sum(k) * middle) / sum(s)
        backoff = (d * (k[0] + scale * k[1]) + toxicity.RARE_CONTEXT) / (s[0] + scale * s[1] + toxicity.RARE_CONTEXT)
        logs = [math.log((1 - backoff) * (max(n[i] - d, 0) / (s[i] - d * k[i]) if s[i] - d * k[i] > 0 else 0) + backoff * both * own[i] / middle) for i in (0, 1)]
        return logs[0] - logs[1], math.log(own[0] / own[1])

    out = defaultdict(list)
    for doc_id, text in docs:
        words = split(text)
        found = [evidence(b, w) for b, w in zip([b"", *words], words)]
        mean = sum(e for e, _ in found) / len(found) if found else 0
        out[doc_id].append((max((e for e, _ in found), default=0), mean, math.log1p(len(words))))
    return out


def test_toxicity_evidence_equals_plain_kneser_ney(spark):
    import pyarrow as pa
    from coordlytics.llm.words import text_slices

    rng = random.Random(11)
    words = [f"word{i}" for i in range(30)] + ["vile", "vilest", "vilely", "é", "Über", "éclat"]
    say = lambda: rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(1, 25)))
    labelled = [(int(rng.random() < 0.4), say()) for _ in range(60)] + [(1, "only here"), (0, ""), (1, "vile vile vile")]
    docs = [(i, t) for i, (_, t) in enumerate(labelled)] + [(500, "never seen words, wordless vilextra"), (501, None), (502, " "), (503, say() + " new" * 2000)]
    models = toxicity.count_models(spark.createDataFrame(sorted(set(labelled)), "toxic int, text string"))
    want = plain_kneser_ney(labelled, docs)
    own = toxicity.reader()
    for low, high, data, offsets in text_slices(pa.array([t for _, t in docs]), 2000):
        read = own.read(data, offsets)
        found = toxicity.traits_of(models.evidence(own, read), read.first)
        for (d, _), got in zip(docs[low:high], found):
            assert list(got) == pytest.approx(want[d][0], abs=1e-4)


def test_toxicity_sample_is_bounded_in_bytes(spark):
    texts = spark.createDataFrame([(c, f"{c} {i} " + "x" * 50) for c in (0, 1) for i in range(100)] + [(1, None)], "toxic int, text string")
    kept = toxicity._within(texts, 500).collect()
    for c in (0, 1):
        sizes = [len(r["text"] or "") for r in kept if r["toxic"] == c]
        assert 500 <= sum(sizes) < 500 + 60
    assert sorted(map(repr, kept)) == sorted(map(repr, toxicity._within(texts.repartition(5), 500).collect()))
    assert toxicity._within(texts, 10**9).count() == 201


def test_toxicity_counts_what_one_text_has(spark):
    texts = [(1, "all say this"), (1, "all say slurry"), (0, "all say that"), (0, "all say this")]
    models = toxicity.count_models(spark.createDataFrame(texts, "toxic int, text string"))
    bodies = [t.split() for _, t in texts]
    pairs = {(a, b) for w in bodies for a, b in zip(["", *w], w)}
    assert len(models.pairs) == len(pairs)
    assert len(models.words) == len({w for b in bodies for w in b}) + 1  # and the beginning of a text



# --- 7 ------------------------------------------------------------------------------------------

def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 7)
    rng = random.Random(9)
    vectors, labels = [], []
    centres = [[rng.gauss(0, 1) for _ in range(20)] for _ in range(6)]
    for i in range(150):
        spread = rng.choice([0.1, 0.2, 0.3])
        vectors.append([x + rng.gauss(0, spread) for x in centres[i % 6]])
        labels.append(i % 2)
    vectors += [vectors[0], vectors[0], vectors[1], None, [], [0.0] * 20, [1.0, None] * 10, [float("nan")] * 20, [1.0, 2.0], [2.0, 4.0],
                vectors[2], [float("inf")] * 20, [1.0], [-1.0]]
    labels += [0, 1, None, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1]
    ids = [None if i == 5 else i for i in range(len(vectors))]
    df = spark.createDataFrame(
        [(d, v, x, "clash") for d, v, x in zip(ids, vectors, labels)], "vec_id long, embedding array<double>, label int, `key` string")
    links = brute.cosine_links(vectors, labels, 0.93)
    low = brute.components(len(vectors), links)
    want = []
    for i, d in enumerate(ids):
        members = [ids[j] for j in range(len(ids)) if low[j] == low[i] and ids[j] is not None]
        component = min(members, default=None)
        want.append((d, sum(i in pair for pair in links), component, d is not None and d == component))
    got = rows(embeddings.near_duplicates(df), "vec_id", "n_links", "component_id", "kept")
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


# --- 9 ------------------------------------------------------------------------------------------

RULES = [url_filter.Rule("allow", "org"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "Example.org", "/en/1"),
         url_filter.Rule("allow", "example.org", "/es/a/b"), url_filter.Rule("block", "a.example.org", "/")]


def plain_match(host, path):
    fits = [r for r in RULES if (host == r.host.lower() or host.endswith("." + r.host.lower())) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_url_rules(spark):
    urls = [None, "", "no-scheme.org/x", "https://ORG", "https://org/", "http://x.example.org/es/a/bc?d", "http://example.org/es/a/",
            "http://example.org/en/12", "http://a.example.org/es/a/b", "http://a.example.org/en/1", "http://example.org?x=/es/",
            "http://example.org#/es/", "ftp://b.a.example.org", "http://notexample.org/es/", "x://u@org/", "x://org:80/", "a://b://org/",
            "http://example.org./es/", "http://.org/", "http://é.org/É", "http://" + "a." * 3000 + "org/" + "b/" * 5000]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(0, None, "r")], "page_id long, url string, rule string")
    got = url_filter.judge(df, RULES, keep=("page_id",)).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path = url_filter.split_url(urls[r["page_id"]])
        want = plain_match(r["host"], path)
        assert r["path"] == path and r["rule"] == (want.text if want else None)
        assert r["verdict"] == (want.verdict if want else "allow")
    with pytest.raises(ValueError):
        url_filter.build([*RULES, RULES[0]])
    assert url_filter.judge(df.limit(0), RULES).count() == 0


# --- 10 -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, width):
    table = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = brute.near_duplicates([t for _, t in table], width, 80)
    want = []
    for (d, _), (n, low) in zip(table, found):
        ids = [table[j][0] for j in range(len(table)) if found[j][1] == low and table[j][0] is not None]
        component = min(ids, default=None) if n else d
        want.append((d, n, component, d is not None and d == component))
    got = rows(minhash.near_duplicates(docs, width, 80), "doc_id", "n_shingles", "component_id", "kept")
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("members", [200, 800])
def test_links_of_a_group_of_near_copies_grow_with_it(spark, monkeypatch, members):
    """60 words, two of them changed: about as many confirmed pairs and cluster links as members."""
    rng = random.Random(22)
    base, texts = sentence(rng, 60).split(), []
    for i in range(members):
        own = list(base)
        for p in rng.sample(range(60), 2):
            own[p] = f"x{rng.randrange(10**6)}"
        texts.append((i, " ".join(own)))
    kept, stored = {}, minhash.stored

    def counting(df, label):
        out = stored(df, label)
        kept[label] = kept.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(minhash, "stored", counting)
    got = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 5, 80).collect()
    found = brute.near_duplicates([t for _, t in texts], 5, 80) if members <= 200 else None
    if found:
        assert {r["doc_id"]: r["component_id"] for r in got} == {i: low for i, (_, low) in enumerate(found)}
    assert kept["star-pairs"] <= 2 * members and kept["cluster-links"] <= 0.2 * members


def test_python_workers_hold_a_bounded_part_of_a_batch(spark, none, monkeypatch):
    import tracemalloc

    import public_tokenizers
    import pyarrow as pa

    rng = random.Random(9)
    texts = pa.array([sentence(rng, 1000) for _ in range(2000)])  # 9 MB
    ids = pa.array([b"%016d" % i for i in range(2000)])
    seen = []
    # the functions that the operators give to Spark, without Spark
    monkeypatch.setattr(type(none), "mapInArrow", lambda self, f, schema: seen.append(f) or self)
    minhash.sketch(none, 5)
    repeats.anchors(none, 35, 8)
    sentencepiece_codec.coded(none, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
    sentencepiece_codec.model(public_tokenizers.path("piece_bpe_32k.model"))
    for run, columns in zip(seen, [[ids, ids, texts], [ids, texts], [ids, texts]], strict=True):
        batch = pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])
        tracemalloc.start()
        rows_out = sum(len(b) for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows_out >= 2000 and peak < 64e6, (run, rows_out, peak)


def test_near_duplicates_of_nothing(none):
    assert minhash.near_duplicates(none).count() == 0


def test_roots_of_a_long_chain_take_few_jumps(spark, monkeypatch):
    stored, jumps = minhash.stored, []
    monkeypatch.setattr(minhash, "stored", lambda df, label: jumps.append(label) or stored(df, label))
    parents = spark.createDataFrame([(i, i - 1) for i in range(1, 300)] + [(1000, 7), (2001, 2000)], "id long, parent long")
    got = rows(minhash.rooted(parents), "id", "component")
    assert sorted(got) == [(i, 0) for i in range(1, 300)] + [(1000, 0), (2001, 2000)]
    assert len(jumps) <= 10


def test_prefilter_misses_no_key(spark):
    wanted = spark.createDataFrame([(i,) for i in range(0, 9000, 3)] + [(None,)], "k long")
    table = spark.createDataFrame([(i, "x") for i in range(90000)] + [(None, "x")], "id long, v string")
    inside, outside = prefilter.possible(table, F.col("id"), wanted, F.col("k"))
    few, rest = {r[0] for r in rows(inside, "id")}, [r[0] for r in rows(outside, "id")]
    assert few >= {None, *range(0, 9000, 3)} and len(few) < 3001 + 90000 // 10
    assert sorted([*rest, *few], key=repr) == sorted([None, *range(90000)], key=repr)
    nothing, every = prefilter.possible(table, F.col("id"), wanted.limit(0), F.col("k"))
    assert nothing.count() == 0 and every.count() == 90001


def test_one_of_each_reads_all_columns_of_few_rows(spark, docs):
    """Rows that no duplicate can be are not shuffled, and the outcome is that of the plain groups."""
    kept = minhash.one_of_each(docs, 5, 80)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and "strategy=broadcast" in plan
    table = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = brute.near_duplicates([t for _, t in table], 5, 80)
    groups = {low for n, low in found if n}
    assert kept.count() == len(groups) + sum(1 for n, _ in found if not n)
