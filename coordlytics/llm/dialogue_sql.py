"""The SQL of the conversation repair query: the same dynamic programme over four running strings.

A state's best way so far is its cost in eight digits followed by its audit, so that the least string is the
cheapest way and, among equals, the ASCII-least.
"""

from __future__ import annotations


def _after(state: int, cost: str, letter: str) -> str:
    return f"lpad(((substr(v[{state}], 1, 8))::INT + {cost})::VARCHAR, 8, '0') || substr(v[{state}], 9) || '{letter}'"


_INSERTED = f"""[v[1], v[2], least(v[3], {_after(1, '5', 'I')}, {_after(2, '5', 'I')}, {_after(4, '5', 'I')}),
    least(v[4], {_after(3, '5', 'I')}, {_after(1, '10', 'II')}, {_after(2, '10', 'II')})]"""
_KEPT = "(CASE WHEN m[1] = upper(m[1]) THEN 5 ELSE 0 END)"
_RENAMED = "(CASE WHEN m[1] = upper(m[1]) THEN 6 ELSE 1 END)"
_EDITED = f"""[{_after(1, '2', 'D')},
    least({_after(2, '2', 'D')}, CASE WHEN lower(m[1]) = 's' THEN {_after(1, _KEPT, 'K')} END),
    least({_after(3, '2', 'D')},
      CASE WHEN m[1] NOT IN ('b', 'd') THEN least({', '.join(_after(i, _RENAMED, 'R') for i in (1, 2, 4))}) END,
      CASE WHEN lower(m[1]) = 'u' THEN least({', '.join(_after(i, _KEPT, 'K') for i in (1, 2, 4))}) END),
    least({_after(4, '2', 'D')}, CASE WHEN m[1] NOT IN ('b', 'd') THEN {_after(3, _RENAMED, 'R')} END,
      CASE WHEN lower(m[1]) = 'a' THEN {_after(3, _KEPT, 'K')} END)]"""

SQL = rf"""
WITH shares AS (
  SELECT list(list_reduce(range(9), lambda a, b: CASE WHEN b = 0 THEN a WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i::BIGINT)
    ORDER BY i) AS share FROM range(256) t(i)),
ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
given AS (
  SELECT c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, row_number() OVER () AS rid,
    list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')]) AS b
  FROM conversations JOIN ids USING (conv_id)
  UNION ALL
  SELECT c, v.conv_id, turn, coalesce(role, ' '), coalesce(text, ' '), -row_number() OVER (),
    list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(' :' || coalesce(turn::VARCHAR, ' '), '')])
  FROM conversations v JOIN ids i ON v.conv_id IS NULL AND i.conv_id IS NULL),
coded AS (
  SELECT given.*, xor(list_reduce(b, lambda a, x: xor(a >> 8, share[(xor(a, x) & 255) + 1])), 4294967295) % 20 AS kind FROM given, shares),
turns AS (
  SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, rid,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, rid, copy) AS p,
    row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, rid, copy) AS again,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS class
  FROM turns),
marked AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN right(body, 1) IN ('.', '!', '?') THEN class ELSE upper(class) END AS mark,
    lag(class) OVER (PARTITION BY c ORDER BY p) || class AS pair FROM ordered),
convs AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(mark = 'b')::BIGINT AS blank,
    count_if(mark = 'd')::BIGINT AS duplicate, count_if(mark IN ('S', 'U', 'A', 'O'))::BIGINT AS truncated,
    count_if(pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, list(mark ORDER BY p) AS marks FROM marked GROUP BY c),
solved AS (
  SELECT * EXCLUDE (marks), list_reduce(flatten([[[m], ['+']] FOR m IN marks]), lambda v, m: CASE WHEN m[1] = '+' THEN {_INSERTED} ELSE {_EDITED} END,
    ['00000000', NULL, '00000005I', '00000010II']) AS v FROM convs),
best AS (SELECT * EXCLUDE (v), least(v[1], v[4]) AS way FROM solved),
letters AS (
  SELECT c, unnest(string_split(substr(way, 9), '')) AS letter, unnest(range(1, length(way) - 7)) AS i FROM best),
placed AS (
  SELECT *, sum((letter <> 'I')::INT) OVER w AS p, sum((letter <> 'D')::INT) OVER w AS k FROM letters WINDOW w AS (PARTITION BY c ORDER BY i)),
made AS (
  SELECT l.c, l.k, letter, CASE WHEN letter = 'I' THEN '' ELSE m.text END AS text, m.role, m.class,
    max((letter = 'K' AND l.k = 1 AND m.class = 's')::INT) OVER (PARTITION BY l.c) AS system
  FROM placed l LEFT JOIN marked m ON m.c = l.c AND m.p = l.p WHERE letter <> 'D'),
lines AS (
  SELECT c, string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS t
  FROM made GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(substr(way, 1, 8)::BIGINT, 0) AS cost, coalesce(substr(way, 9), '') AS audit,
  sha256(coalesce(t, '')) AS repaired_sha256
FROM ids LEFT JOIN best USING (c) LEFT JOIN lines USING (c)"""
