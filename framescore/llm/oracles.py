"""DuckDB statements of the operators that SQL can express, over the same tables."""

from __future__ import annotations

import string

from framescore.llm import multi_index, quality_rules, turn_repair, warc

#: Shingle sets, their pairs by shared shingles, the links, and what each document reaches.
NGRAM_JOIN = f"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
               '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[ \\t\\n\\x0B\\x0C\\r]+'),
             lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3),
                           lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c
      FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE 100 * c >= 75 * (nx + ny - c)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.y, s.doc_id)) AS component_id
FROM s LEFT JOIN m ON m.x = s.doc_id
"""

ORACLE_SQL = {"op6_ngram_join": NGRAM_JOIN, "op9_quality_rules": quality_rules.ORACLE,
              "op11_warc": warc.ORACLE, "op12_multi_index": multi_index.ORACLE,
              "op13_turn_repair": turn_repair.ORACLE}
