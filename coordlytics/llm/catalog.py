"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coordlytics.llm import dialogue_repair, dialogue_sql, disclosure, disclosure_sql, embeddings, importance, minhash, mixing, quality_rules, repeats, sentencepiece_codec, sharding, token_counts, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ["doc_id"])
    return judged.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


URL_RULES = [
    url_filter.Rule("allow", "org"), url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"), url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents"), 16, ["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), span=35)
    return left.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.93)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = sentencepiece_codec.coded(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
    return coded.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids", "decoded_sha256", "round_trip")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES, keep=("page_id",))


def op10_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)
    return found.drop("text_md5")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.spans_of(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue_repair.repaired_conversations(_table(spark, sf_dir, "conversations"))


SQL: dict[str, str] = {
    "op12_personal_data": disclosure_sql.SQL,
    "op13_conversation_repair": dialogue_sql.SQL,
    "op11_importance_resampling": r"""
WITH shares AS (
  SELECT list(list_reduce(range(9), lambda a, b: CASE WHEN b = 0 THEN a WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i::BIGINT)
    ORDER BY i) AS share FROM range(256) t(i)),
docs AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
used AS (SELECT unnest(w) AS x, 1 AS s, 0 AS t, id FROM docs),
aimed AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x, 0 AS s, 1 AS t FROM benchmark),
words AS (SELECT x, sum(s) AS s, sum(t) AS t FROM (SELECT x, s, t FROM used UNION ALL SELECT x, s, t FROM aimed) GROUP BY x),
bytes AS (
  SELECT x, s, t, [('0x' || substr(hex(encode(x)), 2 * i - 1, 2))::BIGINT FOR i IN range(1, length(hex(encode(x))) // 2 + 1)] AS b
  FROM words),
hashed AS (
  SELECT x, s, t, xor(list_reduce(b, lambda a, c: xor(a >> 8, share[(xor(a, c) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM bytes, shares),
counts AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket),
total AS (SELECT sum(s) AS s, sum(t) AS t FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln(((c.t + 1) * (coalesce(total.s, 0) + 10000))::DOUBLE / ((c.s + 1) * (coalesce(total.t, 0) + 10000))::DOUBLE))::BIGINT AS gain
  FROM counts c, total),
weights AS (SELECT id, sum(gain)::BIGINT AS weight FROM used JOIN hashed USING (x) JOIN gains USING (bucket) GROUP BY id),
scored AS (
  SELECT id, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE
      / 4294967296))))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (id)),
drawn AS (
  SELECT id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place,
    10 * count(*) OVER () // 100 AS drawn FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END::BIGINT AS rank
FROM scored LEFT JOIN drawn USING (id)""",
    "op7_embedding_near_duplicates": r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS id, vec_id, label, embedding::DOUBLE[] AS e,
    label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
links AS (
  SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.ok AND b.ok AND a.label = b.label AND a.id <> b.id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
counts AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a),
reach AS (SELECT id, id AS other FROM v UNION SELECT l.b, r.other FROM reach r JOIN links l ON l.a = r.id),
lowest AS (SELECT r.id, min(o.vec_id) AS component_id FROM reach r JOIN v o ON o.id = r.other GROUP BY r.id)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN lowest USING (id) LEFT JOIN counts USING (id)""",
    "op5_substring_dedup": r"""
WITH split AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT id, i, array_to_string(w[i:i + 34], ' ') AS x FROM (SELECT id, w, unnest(range(1, len(w) - 33)) AS i FROM split)),
again AS (SELECT md5(x) AS m FROM windows GROUP BY 1 HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT id, unnest(range(i, i + 35)) AS p FROM windows JOIN again ON md5(x) = m),
lost AS (SELECT id, count(*) AS n, list(p) AS ps FROM gone GROUP BY id),
kept AS (
  SELECT s.id, string_agg(s.x, ' ' ORDER BY s.p) AS t
  FROM (SELECT id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM split) s
  LEFT JOIN gone g ON g.id = s.id AND g.p = s.p WHERE g.p IS NULL GROUP BY s.id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(l.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM split LEFT JOIN lost l USING (id) LEFT JOIN kept k USING (id)""",
    "op10_minhash_near_duplicates": r"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT id, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM split),
items AS (SELECT id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.id AS a, b.id AS b FROM items a JOIN items b ON a.x = b.x AND a.id <> b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT id, id AS other FROM sets UNION SELECT l.b, r.other FROM reach r JOIN links l ON l.a = r.id),
lowest AS (SELECT r.id, min(o.doc_id) AS component_id FROM reach r JOIN sets o ON o.id = r.other GROUP BY r.id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN lowest USING (id)""",
    "op1_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(concat('mix', chr(31), coalesce(doc_id::VARCHAR, chr(0)))) AS k FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r
  FROM sized GROUP BY source),
weighed AS (SELECT *, ((r - 1) % 3 + 1)::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, cap / w AS ratio, (SELECT sum(source_size)::DOUBLE FROM sources) AS budget,
    coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_up,
    sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left FROM weighed),
water AS (
  SELECT (budget - full_up) / weights_left AS water FROM levels
  WHERE (budget - full_up) / weights_left <= ratio ORDER BY ratio, r LIMIT 1),
targets AS (SELECT source, source_size, r, w, least(cap, water * w) AS target FROM weighed, water),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.r, t.w, row_number() OVER () AS id,
    sum(s.size) OVER (PARTITION BY t.r ORDER BY s.k, s.doc_id::VARCHAR, s.size ROWS UNBOUNDED PRECEDING) AS cum
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
turns AS (
  SELECT p.*, (p.cum + p.source_size * e.e)::DOUBLE / p.w AS finish
  FROM placed p, (VALUES (0), (1), (2)) e(e)),
ordered AS (SELECT id, size, sum(size) OVER (ORDER BY finish, r ROWS UNBOUNDED PRECEDING) AS upto FROM turns WHERE size > 0),
fits AS (SELECT id, count(*) AS n FROM ordered WHERE upto <= (SELECT sum(size) FROM sized) GROUP BY id)
SELECT p.doc_id, p.size, p.source_size, p.target, (p.size * coalesce(f.n, 0))::BIGINT AS taken
FROM placed p LEFT JOIN fits f ON p.id = f.id""",
    "op9_url_filter": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
raw AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM cut),
parts AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path, row_number() OVER () AS id FROM raw),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
  SELECT id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (id)""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mix_sources, op2_quality_rules, op3_token_counts, op4_shards, op5_substring_dedup, op6_toxicity,
        op7_embedding_near_duplicates, op8_sentencepiece, op9_url_filter, op10_minhash_near_duplicates,
        op11_importance_resampling, op12_personal_data, op13_conversation_repair)}
