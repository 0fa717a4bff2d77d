"""The registered queries against their SQL, and the pipeline stage by stage."""

import random

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from coordlytics.llm import catalog, mixing
from coordlytics.llm.store import stored
from oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, name):
    assert difference(catalog.QUERIES[name](spark, FOLDER), connect(FOLDER), catalog.SQL[name]) is None


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = stored(stage(spark, docs, FOLDER), "test-stage")
        if name != "pieces":
            assert docs.columns == columns
    order = [n for n, _ in corpus_pipeline.STAGES]
    outputs = {n: (inputs | {"end": docs})[m] for n, m in zip(order, [*order[1:], "end"])}
    text_of = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    kept = text_of(outputs["quality rules"])
    bad = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 0").collect()}
    for d, text in text_of(inputs["quality rules"]).items():
        n, _, symbols, _, repeated = brute.statistics(text)
        if n < 10 or 5 * repeated > n:
            assert d not in kept
        elif d not in kept:
            assert symbols > 0 or d in bad

    before = text_of(inputs["near duplicates"])
    ids = sorted(before)
    found = brute.near_duplicates([before[d] for d in ids], corpus_pipeline.SHINGLE, corpus_pipeline.SIMILARITY)
    assert set(text_of(outputs["near duplicates"])) == {d for i, (d, (n, low)) in enumerate(zip(ids, found)) if not n or low == i}

    before = text_of(inputs["substring dedup"])
    want = dict(zip(before, (w[3] for w in brute.without_repeats(list(before.values()), corpus_pipeline.SPAN))))
    after = text_of(outputs["substring dedup"])
    assert {d: brute.words(t) for d, t in after.items()} == want

    shares = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.shares(inputs["mixing sources"]).collect() if r["taken"]}
    counts = {r["doc_id"]: r["count"] for r in outputs["mixing sources"].groupBy("doc_id").count().collect()}
    assert counts == shares

    coded = outputs["pieces"]
    assert coded.count() == inputs["pieces"].count() and coded.filter(~F.col("round_trip")).count() == 0


def test_one_row_of_each_group_survives_substring_dedup(spark):
    rng = random.Random(12)
    text = [" ".join(f"w{rng.randint(0, 999)}" for _ in range(60)) for _ in range(7)]
    table = [
        (1, text[0], "a"), (1, text[0], "a"),  # a row ingested twice
        (2, text[1], "b"), (2, text[1], "a"),  # which differ in another column
        (None, text[2], "a"), (None, text[2], "a"),  # copies without an id
        (None, text[3] + " x", "a"), (None, text[3] + " y", "a"),  # near copies without an id
        (3, text[4] + " x", "a"), (3, text[4] + " y", "a"), (4, text[4], "a"),  # one id of two texts
        (None, text[5], "a"), (9, text[5], "a"),  # an id is preferred
        (5, text[6], "a"), (6, "", "a"), (6, "", "a"), (None, None, "a")]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string")
    once = stored(corpus_pipeline.near_duplicates(spark, docs, FOLDER), "test-stage")
    got = once.collect()
    assert len(got) == 7 + 3  # and all texts without words
    for t in text:
        assert sum((r["text"] or "").startswith(t) for r in got) == 1
    assert [r["doc_id"] for r in got if r["text"] == text[5]] == [9]
    assert [r["doc_id"] for r in got if (r["text"] or "").startswith(text[4])] == [3]
    cleaned = corpus_pipeline.substrings(spark, once, FOLDER).collect()
    assert sorted(r["text"] or "" for r in cleaned) == sorted(r["text"] or "" for r in got)


def test_pipeline_of_nothing(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
