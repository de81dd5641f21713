"""DuckDB SQL of the queries whose results SQL can express, written apart from the Spark plans."""

#: CRC-32 goes bit by bit: each character is followed by eight shifts (marked -1). The repair is
#: a forward pass that keeps each state's cheapest, then least audit, with the rows it gives.
CONVERSATION_REPAIR = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(key, ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) % 20 AS kind FROM raw),
spoilt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM spoilt),
faulty AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
              WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
inserts(p, k, state, given) AS (VALUES
  ('', 0, '', CAST([] AS VARCHAR[])), ('', 1, 'u', ['user:']), ('', 2, 'a', ['user:', 'assistant:']),
  ('s', 0, 's', []), ('s', 1, 'u', ['user:']), ('s', 2, 'a', ['user:', 'assistant:']),
  ('u', 0, 'u', []), ('u', 1, 'a', ['assistant:']), ('a', 0, 'a', []), ('a', 1, 'u', ['user:'])),
edits(p, op, initial, q, cost, role) AS (
  SELECT s, 'D', CAST(NULL AS VARCHAR), s, 4, CAST(NULL AS VARCHAR) FROM (VALUES (''), ('s'), ('u'), ('a')) t(s) UNION ALL VALUES
  ('', 'R', NULL, 'u', 3, 'user'), ('s', 'R', NULL, 'u', 3, 'user'), ('u', 'R', NULL, 'a', 3, 'assistant'), ('a', 'R', NULL, 'u', 3, 'user'),
  ('', 'K', 's', 's', 0, NULL), ('', 'K', 'u', 'u', 0, NULL), ('s', 'K', 'u', 'u', 0, NULL), ('u', 'K', 'a', 'a', 0, NULL), ('a', 'K', 'u', 'u', 0, NULL)),
best AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '' AS state, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS given FROM faulty
  UNION ALL
  SELECT b.conv_id, f.i, e.q, b.cost + 3 * n.k + e.cost + CASE WHEN f.fault = 3 AND e.op <> 'D' THEN 3 ELSE 0 END AS total,
         b.audit || repeat('I', n.k) || e.op AS audit,
         b.given || n.given || CASE WHEN e.op = 'D' THEN [] ELSE [coalesce(e.role, f.role) || ':' || f.text] END
  FROM best b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1
  JOIN inserts n ON n.p = b.state JOIN edits e ON e.p = n.state AND (e.initial IS NULL OR e.initial = f.initial) AND (e.op = 'D' OR f.fault IN (0, 3))
  QUALIFY row_number() OVER (PARTITION BY b.conv_id, e.q ORDER BY total, b.audit || repeat('I', n.k) || e.op) = 1),
ended AS (
  SELECT b.conv_id, b.cost + 3 * n.k AS cost, b.audit || repeat('I', n.k) AS audit, b.given || n.given AS given
  FROM best b JOIN (SELECT conv_id, max(i) AS i FROM faulty GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM b.conv_id AND l.i = b.i
  JOIN inserts n ON n.p = b.state AND n.state IN ('', 'a') AND (n.k > 0 OR b.state IN ('', 'a'))
  QUALIFY row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + 3 * n.k, b.audit || repeat('I', n.k)) = 1),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(given, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""

LEXICAL_SEARCH = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
i AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
qt AS (SELECT q, t, count(*) AS times FROM (SELECT q, unnest(terms) AS t FROM i) GROUP BY q, t),
s AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, CAST(sum(len(terms)) AS BIGINT) AS length FROM d),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(terms) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t, docs),
x AS (SELECT r, t, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(terms) * docs) // length)) AS x FROM tf JOIN d USING (r), s),
scored AS (SELECT q, r, CAST(sum(w * times * x) AS BIGINT) AS score FROM qt JOIN w USING (t) JOIN x USING (t) GROUP BY q, r HAVING sum(w * times * x) > 0),
ranked AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored JOIN d USING (r))
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN i USING (q) WHERE rank <= 20
"""
