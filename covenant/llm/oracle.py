"""DuckDB SQL of the queries of this subpackage that SQL can express."""

CONTAINMENT = r"""
WITH iw AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM benchmark),
ik AS (SELECT item_id, ws, least(len(ws), 5) AS k FROM iw WHERE len(ws) > 0),
ip AS (SELECT item_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS p FROM ik),
items AS (SELECT DISTINCT item_id, ws, array_to_string(ws[p:p + k - 1], ' ') AS s FROM ip),
sizes AS (SELECT item_id, ws, count(*) AS n_item FROM items GROUP BY ALL),
dw AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws, text FROM documents),
dp AS (SELECT doc_id, text, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS p
       FROM dw, (SELECT DISTINCT k FROM ik) WHERE len(ws) >= k),
held AS (SELECT DISTINCT doc_id, text, array_to_string(ws[p:p + k - 1], ' ') AS s FROM dp),
hits AS (SELECT doc_id, text, item_id, items.ws AS ws, count(*) AS n_shared FROM held JOIN items USING (s) GROUP BY ALL),
best AS (SELECT doc_id, text, item_id, n_shared, n_item, n_shared / n_item AS containment
         FROM hits JOIN sizes USING (item_id, ws) WHERE n_shared / n_item >= 0.8
         QUALIFY row_number() OVER (PARTITION BY doc_id, text, item_id ORDER BY n_shared / n_item DESC, n_shared DESC) = 1)
SELECT doc_id, item_id, n_shared, CAST(n_item AS INTEGER) AS n_item, containment FROM best
"""

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(replace(role, '\', '\\'), '### ', '\h'), '</turn>', '\e'), ': ', '\c') AS erole,
         replace(replace(replace(replace(text, '\', '\\'), '### ', '\h'), '</turn>', '\e'), ': ', '\c') AS etext FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(erole) + 2 + length(etext) + 8) AS BIGINT) AS formatted_chars,
       regexp_full_match(string_agg(role || ',', '' ORDER BY turn NULLS FIRST, role, text),
                         '(system,)?user,assistant,((tool|user),assistant,)*') AS turn_order_ok
FROM escaped GROUP BY conv_id
"""

FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                       OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
                  WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b FROM e),
s AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1, n - b) AS suf FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM s
"""

PREFIX_TRIE = r"""
WITH RECURSIVE src AS (
  SELECT CAST(conv_id AS BIGINT) AS conv, turn, length(coalesce(text, '')) AS chars,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, t) AS pos FROM src),
ids AS (SELECT DISTINCT conv, CAST(conv AS VARCHAR) AS s FROM src),
bits AS (  -- crc32 of the decimal id, one bit a step: a byte comes in at the first of its eight bits
  SELECT conv, s, 0 AS i, CAST(4294967295 AS BIGINT) AS crc FROM ids
  UNION ALL
  SELECT conv, s, i + 1,
         CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END
  FROM (SELECT conv, s, i, CASE WHEN i % 8 = 0 THEN xor(crc, CAST(ascii(s[i // 8 + 1]) AS BIGINT)) ELSE crc END AS x
        FROM bits WHERE i < 8 * length(s))),
grafts AS (SELECT conv, conv - conv % 100 AS base, xor(crc, CAST(4294967295 AS BIGINT)) % 6 AS h FROM bits WHERE i = 8 * length(s)),
parts AS (
  SELECT g.conv, 0 AS side, n.pos, n.t, n.chars FROM grafts g JOIN numbered n ON n.conv = g.base AND n.pos <= g.h
  UNION ALL SELECT g.conv, 1, n.pos, n.t, n.chars FROM grafts g JOIN numbered n ON n.conv = g.conv AND n.pos > g.h),
rebuilt AS (SELECT conv, row_number() OVER (PARTITION BY conv ORDER BY side, pos) AS depth, t, chars FROM parts),
paths AS (SELECT conv, depth, chars, md5(string_agg(t, '') OVER (PARTITION BY conv ORDER BY depth)) AS node FROM rebuilt
          UNION ALL SELECT conv, 0, 0, 'root' FROM ids),
linked AS (SELECT *, lag(node) OVER (PARTITION BY conv ORDER BY depth) AS parent,
                  max(depth) OVER (PARTITION BY conv) AS size FROM paths),
nodes AS (SELECT node, depth, min(conv) AS conv_id, min(parent) AS parent, count(*) AS n_convs, min(chars) AS chars,
                 string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (depth = size) AS ends
          FROM linked GROUP BY node, depth),
kids AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
facts AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.parent = n.node AND k.depth = n.depth),
sums AS (  -- a node counts for every node on the path of its smallest member down to it
  SELECT p.node, p.depth, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved
  FROM facts f JOIN paths p ON p.conv = f.conv_id AND p.depth <= f.depth GROUP BY p.node, p.depth)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM facts f JOIN sums s ON s.node = f.node AND s.depth = f.depth
LEFT JOIN nodes u ON u.node = f.parent AND u.depth = f.depth - 1
"""
