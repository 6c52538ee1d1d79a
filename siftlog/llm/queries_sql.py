"""SQL of the training-data queries that SQL can express."""

from __future__ import annotations

#: 8 steps of the reflected polynomial for one byte, then over the bytes of a key.
_BYTE = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda s: ascii(s)::bigint)), lambda c, b: " + _BYTE + "), 4294967295)"


def _best(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _way(cost: str, letter: str, after: str) -> str:
    return "{'c': " + f"{cost} + {after}.c, 'a': '{letter}' || {after}.a" + "}"


#: Cheapest ways from each state (0 start, 1 after s, 2 after u, 3 after a) through row i and all after it, before inserts.
_NONE = "{'c': 1000000000, 'a': ''}"
_MORE = "CASE WHEN r.truncated THEN 3 ELSE 0 END"


def _through(state: int) -> str:
    to = 3 if state == 2 else 2
    new = "a" if state == 2 else "u"
    ways = [_way("4", "D", f"v{state}"), f"CASE WHEN r.go THEN {_NONE} ELSE {_way(f'3 + {_MORE}', 'R', f'v{to}')} END"]
    ways.append(f"CASE WHEN NOT r.go AND r.initial = '{new}' THEN {_way(_MORE, 'K', f'v{to}')} ELSE {_NONE} END")
    if state == 0:
        ways.append(f"CASE WHEN NOT r.go AND r.initial = 's' THEN {_way(_MORE, 'K', 'v1')} ELSE {_NONE} END")
    return _best(*ways)


CONVERSATIONS = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS k FROM conversations
), drawn AS (SELECT *, {_CRC} % 20 AS kind FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn WHERE kind <> 0
), numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), faults AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS open,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair
  FROM numbered
), rows AS (SELECT *, blank OR again AS go, NOT blank AND NOT again AND open AS truncated FROM faults
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM rows GROUP BY conv_id
), ways AS (
  SELECT conv_id, n AS i, {{'c': 0, 'a': ''}} AS v0, {{'c': 6, 'a': 'II'}} AS v1, {{'c': 3, 'a': 'I'}} AS v2, {{'c': 0, 'a': ''}} AS v3 FROM counts
  UNION ALL
  SELECT conv_id, i - 1, {_best("b0", _way("3", "I", "b2"), _way("6", "II", "b3"))}, {_best("b1", _way("3", "I", "b2"), _way("6", "II", "b3"))}, {_best("b2", _way("3", "I", "b3"))}, {_best("b3", _way("3", "I", "b2"))}
  FROM (SELECT w.conv_id, w.i, {", ".join(f"{_through(s)} AS b{s}" for s in range(4))} FROM ways w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i)
), audits AS (SELECT conv_id, v0.c AS cost, v0.a AS audit FROM ways WHERE i = 0
), letters AS (
  SELECT conv_id, audit[j] AS letter, j, length(replace(audit[:j], 'I', '')) AS i, length(replace(audit[:j], 'D', '')) AS place
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM audits)
), written AS (
  SELECT l.conv_id, l.j, l.place, l.letter, r.role, CASE l.letter WHEN 'I' THEN '' ELSE r.text END AS text,
    max(CASE WHEN l.place = 1 AND l.letter = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS systems
  FROM letters l LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i WHERE l.letter <> 'D'
), repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - systems) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS sha FROM written GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate, coalesce(truncated, 0)::bigint AS truncated,
  coalesce(illegal, 0)::bigint AS illegal, coalesce(cost, 0)::bigint AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired p ON p.conv_id IS NOT DISTINCT FROM o.conv_id
"""

_TERMS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

RANKED = f"""
WITH terms AS (SELECT doc_id, unnest({_TERMS.format("text")}) AS term FROM documents
), tfs AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term
), lengths AS (SELECT doc_id, sum(tf)::bigint AS n FROM tfs GROUP BY doc_id
), corpus AS (SELECT count(*) AS big_n, sum(n)::bigint AS big_l FROM lengths
), weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)))::bigint AS w FROM tfs, corpus GROUP BY term, big_n
), wanted AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark) GROUP BY item_id, term
), scored AS (
  SELECT item_id, t.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::bigint AS score
  FROM wanted JOIN tfs t USING (term) JOIN weights USING (term) JOIN lengths l ON l.doc_id = t.doc_id, corpus GROUP BY item_id, t.doc_id
), ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::integer AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
