"""The SQL of the personal data query: spans from what lies between matches, co-occurrence by plain grouping."""

from __future__ import annotations

_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _places(source: str, text: str, pattern: str, carried: str) -> str:
    """Matches of ``pattern`` with their first code point s, and the text before and after each."""
    return f"""
  SELECT {carried}, i, m[i] AS v, p[i] AS gap, p[i + 1] AS rest,
    (list_sum([length(x) FOR x IN p[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0))::BIGINT AS s
  FROM (SELECT {carried}, p, m, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT {carried}, string_split_regex({text}, '{pattern}') AS p, regexp_extract_all({text}, '{pattern}') AS m FROM {source}) WHERE len(m) > 0)"""


def _told(both: str, term: str) -> str:
    windows = "greatest(windows, n_entity + 1.0)"
    return f"log2(least({both}, {term})::DOUBLE * {windows} / (n_entity * {term})) / log2({windows} / n_entity)"


_FOUND = "\n  UNION ALL".join(
    f"\n  SELECT *, '{kind}' AS kind, {rank} AS rank FROM ({_places('docs', 't', pattern, 'id')})" for rank, (kind, pattern) in enumerate(_KINDS.items()))

SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_FOUND}),
plain AS (
  SELECT *, s + length(v) AS e, CASE kind WHEN 'email' THEN lower(v) WHEN 'ip' THEN v ELSE regexp_replace(v, '[^0-9]', '', 'g') END AS value FROM found),
valid AS (
  SELECT *, kind || ':' || value AS entity, row_number() OVER () AS mention, right(gap, 160) AS before, left(rest, 160) AS after FROM plain
  WHERE CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(nullif(ltrim(x, '0'), '') AS INT), 0) > 255)) = 0
    WHEN 'card' THEN length(value) BETWEEN 14 AND 19 AND list_sum([
      CASE WHEN k % 2 = 1 THEN substr(value, length(value) - k + 1, 1)::INT
        ELSE 2 * substr(value, length(value) - k + 1, 1)::INT // 10 + 2 * substr(value, length(value) - k + 1, 1)::INT % 10 END
      FOR k IN range(1, length(value) + 1)]) % 10 = 0
    WHEN 'phone' THEN length(value) BETWEEN 10 AND 15 ELSE true END),
vocabulary AS (
  SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(t), '{_TERM}')) AS term FROM docs) GROUP BY term),
earlier AS (
  SELECT id, entity, mention, v, start + s - length(before) AS s FROM (
    SELECT *, row_number() OVER (PARTITION BY mention ORDER BY i DESC) AS near FROM (
      {_places("(SELECT id, entity, mention, s AS start, before FROM valid)", "before", _TERM, "id, entity, mention, start, before")})
    WHERE s > 0 OR length(before) < 160) WHERE near <= 6),
later AS (
  SELECT id, entity, mention, v, stop + s AS s FROM (
    SELECT *, row_number() OVER (PARTITION BY mention ORDER BY i) AS near FROM (
      {_places("(SELECT id, entity, mention, e AS stop, after FROM valid)", "after", _TERM, "id, entity, mention, stop, after")})
    WHERE s + length(v) < 160 OR length(after) < 160) WHERE near <= 6),
near AS (SELECT *, lower(v) AS term, s + length(v) AS e FROM (SELECT * FROM earlier UNION ALL SELECT * FROM later)),
entities AS (SELECT entity, count(*) AS n_entity FROM valid GROUP BY entity),
total AS (SELECT coalesce(sum(n), 0) / 13.0::DOUBLE AS windows FROM vocabulary),
pairs AS (SELECT entity, term, count(DISTINCT mention) AS n_both FROM near GROUP BY entity, term HAVING count(DISTINCT mention) >= 3),
heads AS (SELECT left(term, 3) AS head, sum(n)::BIGINT AS n_head FROM vocabulary GROUP BY 1),
shared AS (SELECT entity, left(term, 3) AS head, sum(n_both)::BIGINT AS n_shared FROM pairs GROUP BY ALL),
risky AS (
  SELECT p.entity, p.term, CASE WHEN length(p.term) > 3 AND {_told("n_shared", "n_head")} < 0.9 THEN 4 ELSE 5 END AS rank
  FROM pairs p JOIN entities USING (entity) JOIN vocabulary v USING (term) JOIN heads h ON h.head = left(p.term, 3)
    JOIN shared s ON s.entity = p.entity AND s.head = h.head, total
  WHERE {_told("n_both", "v.n")} >= 0.9),
chosen AS (SELECT id, s, e, max(rank) AS rank FROM near JOIN risky USING (entity, term) GROUP BY ALL),
added AS (
  SELECT * FROM chosen c WHERE NOT EXISTS (SELECT 1 FROM valid b WHERE b.id = c.id AND b.s < c.e AND c.s < b.e)),
named AS (
  SELECT id, s, e, rank, kind FROM valid
  UNION ALL SELECT id, s, e, rank, CASE rank WHEN 4 THEN 'generalise' ELSE 'remove' END FROM added),
per AS (
  SELECT id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
    count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (rank < 4) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans FROM named GROUP BY id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (id)"""
