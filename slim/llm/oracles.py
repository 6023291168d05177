"""DuckDB equivalents of the queries that SQL can express: plain definitions, not the operators' methods."""

from __future__ import annotations

# Every 50-byte string with the smallest document that has it; what larger ones have of it goes.
REPEATS = """WITH bytes AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
strings AS (SELECT doc_id, p, b[p + 1 : p + 50] AS s FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 49)) AS p FROM bytes WHERE octet_length(b) >= 50)),
owners AS (SELECT s, min(doc_id) AS o FROM strings GROUP BY 1),
hits AS (SELECT doc_id, p FROM strings JOIN owners USING (s) WHERE o < doc_id GROUP BY ALL),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER w + 50 THEN 0 ELSE 1 END AS fresh FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
numbered AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM marked),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM numbered GROUP BY doc_id, n),
cuts AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM spans
  UNION ALL SELECT doc_id, coalesce(max(z), 0), octet_length(any_value(b)) FROM bytes LEFT JOIN spans USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(hex(b[a + 1 : z]), '' ORDER BY a) AS h FROM cuts JOIN bytes USING (doc_id) WHERE z > a GROUP BY 1),
sums AS (SELECT doc_id, sum(z - a) AS r, count(*) AS n FROM spans GROUP BY 1)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM bytes LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)"""

# Generalised Jaccard of all pairs that share a shingle, then components by the least label within reach.
NEAR = r"""WITH RECURSIVE texts AS (SELECT text, min(doc_id) AS node FROM documents WHERE text IS NOT NULL GROUP BY 1),
split AS (SELECT node, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x != '') AS w FROM texts),
shingled AS (
  SELECT node, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s, least(len(w), 5) AS k FROM split),
counts AS (SELECT node, s, k, count(*) AS c FROM shingled GROUP BY ALL),
sizes AS (SELECT node, sum(c) AS n FROM counts GROUP BY 1),
shared AS (SELECT x.node AS a, y.node AS b, sum(least(x.c, y.c)) AS m FROM counts x JOIN counts y ON x.s = y.s AND x.k = y.k AND x.node < y.node GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.node = a JOIN sizes q ON q.node = b WHERE m >= 0.8 * (p.n + q.n - m) - 1e-9),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, label) AS (SELECT node, node FROM texts UNION SELECT edges.b, reach.label FROM reach JOIN edges ON edges.a = reach.node WHERE reach.label < edges.b),
labels AS (SELECT node, min(label) AS class_id FROM reach GROUP BY 1)
SELECT d.doc_id, class_id, node = class_id AND d.doc_id = node AS first, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles
FROM documents d JOIN texts USING (text) JOIN labels USING (node) LEFT JOIN sizes USING (node)"""


# Rebuilt conversations as lists of turns; a node is a list. CRC-32 of the decimal id, bit by bit.
TRIE = """WITH ordered AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
bytes AS (SELECT c, turns, list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)) AS b FROM ordered),
crc AS (
  SELECT c, turns, xor(list_reduce(b, lambda a, x: list_reduce(list_concat([xor(a, x)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 6 AS h FROM bytes),
rebuilt AS (SELECT x.c, list_concat(coalesce(y.turns, [])[1 : x.h], x.turns[x.h + 1 :]) AS turns FROM crc x LEFT JOIN crc y ON y.c = x.c - x.c % 100),
prefixes AS (SELECT c, d, turns[1 : d] AS node, len(turns) AS n FROM rebuilt, unnest(range(0, len(turns) + 1)) AS u(d)),
nodes AS (
  SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, max(n) AS longest, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends
  FROM prefixes GROUP BY ALL),
saved AS (SELECT node, d, CASE WHEN d > 0 THEN (n_convs - 1) * length(node[d].t) ELSE 0 END AS s, (longest = d)::BIGINT AS leaf FROM nodes),
above AS (SELECT node[1 : k] AS node, s, leaf FROM saved, unnest(range(0, d + 1)) AS u(k)),
sums AS (SELECT node, sum(leaf) AS n_leaves, sum(s) AS saved_tokens FROM above GROUP BY 1),
kids AS (SELECT node[1 : d - 1] AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM nodes v LEFT JOIN nodes p ON v.d > 0 AND p.d = v.d - 1 AND p.node = v.node[1 : v.d - 1] LEFT JOIN kids k ON k.node = v.node JOIN sums ON sums.node = v.node"""


def oracle_sql() -> dict[str, str]:
    return {"op2_repeats_removed": REPEATS, "op3_near_duplicates": NEAR, "op12_conversation_trie": TRIE}
