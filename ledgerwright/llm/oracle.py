"""DuckDB SQL of conversation repair and phrase mining, written from their contracts."""

#: CRC-32 byte by byte; the texts it is used for are digits, colons, signs and spaces.
_CRC = """
crc AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256)) AS i))"""

REPAIR_SQL = f"""
WITH RECURSIVE {_CRC},
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations),
kinds AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc.tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM keyed, crc),
struck AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM struck),
faulty AS (
  SELECT *, left(role, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
      WHEN right(regexp_replace(text, '[\\x20\\x09-\\x0D]+$', ''), 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed),
sizes AS (SELECT conv_id, count(*) AS n FROM faulty GROUP BY conv_id),
dp AS (
  SELECT conv_id, n + 1 AS pos, {{'c': 0, 't': ''}} AS v0, {{'c': 6, 't': 'II'}} AS vs, {{'c': 3, 't': 'I'}} AS vu, {{'c': 0, 't': ''}} AS va FROM sizes
  UNION ALL
  SELECT conv_id, pos,
    least(d0, {{'c': du.c + 3, 't': 'I' || du.t}}, {{'c': da.c + 6, 't': 'II' || da.t}}),
    least(ds, {{'c': du.c + 3, 't': 'I' || du.t}}, {{'c': da.c + 6, 't': 'II' || da.t}}),
    least(du, {{'c': da.c + 3, 't': 'I' || da.t}}), least(da, {{'c': du.c + 3, 't': 'I' || du.t}})
  FROM (
    SELECT p.conv_id, f.pos,
      list_min(list_filter([{{'c': v0.c + 4, 't': 'D' || v0.t}},
        CASE WHEN stay AND initial = 's' THEN {{'c': vs.c + more, 't': 'K' || vs.t}} WHEN stay AND initial = 'u' THEN {{'c': vu.c + more, 't': 'K' || vu.t}} END,
        CASE WHEN stay THEN {{'c': vu.c + 3 + more, 't': 'R' || vu.t}} END], lambda x: x IS NOT NULL)) AS d0,
      list_min(list_filter([{{'c': vs.c + 4, 't': 'D' || vs.t}}, CASE WHEN stay AND initial = 'u' THEN {{'c': vu.c + more, 't': 'K' || vu.t}} END,
        CASE WHEN stay THEN {{'c': vu.c + 3 + more, 't': 'R' || vu.t}} END], lambda x: x IS NOT NULL)) AS ds,
      list_min(list_filter([{{'c': vu.c + 4, 't': 'D' || vu.t}}, CASE WHEN stay AND initial = 'a' THEN {{'c': va.c + more, 't': 'K' || va.t}} END,
        CASE WHEN stay THEN {{'c': va.c + 3 + more, 't': 'R' || va.t}} END], lambda x: x IS NOT NULL)) AS du,
      list_min(list_filter([{{'c': va.c + 4, 't': 'D' || va.t}}, CASE WHEN stay AND initial = 'u' THEN {{'c': vu.c + more, 't': 'K' || vu.t}} END,
        CASE WHEN stay THEN {{'c': vu.c + 3 + more, 't': 'R' || vu.t}} END], lambda x: x IS NOT NULL)) AS da
    FROM dp p JOIN (SELECT conv_id, pos, initial, fault NOT IN ('b', 'd') AS stay, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS more FROM faulty) f
      ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.pos = p.pos - 1)),
best AS (SELECT conv_id, v0.c AS cost, v0.t AS audit FROM dp WHERE pos = 1),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS i FROM best WHERE audit <> ''),
counted AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS r, count(*) FILTER (letter <> 'D') OVER w AS k
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
out AS (
  SELECT c.conv_id, c.letter, c.k, f.role, f.text, max(CASE WHEN c.k = 1 AND c.letter = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c.conv_id) AS lead
  FROM counted c LEFT JOIN faulty f ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND c.letter <> 'I' AND c.r = f.pos
  WHERE c.letter <> 'D'),
sums AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS repaired_sha256
  FROM out GROUP BY conv_id),
counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM faulty GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts n ON o.conv_id IS NOT DISTINCT FROM n.conv_id
LEFT JOIN best p ON o.conv_id IS NOT DISTINCT FROM p.conv_id
LEFT JOIN sums h ON o.conv_id IS NOT DISTINCT FROM h.conv_id
"""

PHRASE_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
listed AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM pieces),
phrases AS (
  SELECT lang, k, unnest(list_transform(range(1, greatest(len(ws) - k + 1, 0) + 1), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM listed, (VALUES (1), (2), (3)) AS v(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM phrases GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
halves AS MATERIALIZED (
  SELECT lang, phrase, f AS a, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)),
cuts AS (
  SELECT h.lang, h.phrase, a, cut, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM halves h JOIN f x ON x.lang = h.lang AND x.phrase = head JOIN f y ON y.lang = h.lang AND y.phrase = tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase, f FROM candidates WHERE k = 3),
dropped AS (
  SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN longer g ON c.k = 2 AND g.lang = c.lang AND g.phrase = c.phrase AND 100 * g.f >= 50 * c.f),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b ANTI JOIN dropped d ON b.lang = d.lang AND b.phrase = d.phrase)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r.r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""
