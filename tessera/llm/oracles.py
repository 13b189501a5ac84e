"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import lines, mixing

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = f"""
WITH p AS (
  SELECT page_id, coalesce(regexp_extract(lower(url), '{lines.HOST}', 1), '') AS host,
         list_filter(list_transform(string_split(regexp_replace(regexp_replace(html, '{lines.SCRIPT_OR_STYLE}', chr(10), 'g'), '{lines.TAG}', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls
  FROM pages),
t AS (SELECT host, count(*) AS n FROM p GROUP BY host),
l AS (SELECT host, unnest(list_distinct(ls)) AS line FROM p),
b AS (
  SELECT l.host, list(l.line) AS bad
  FROM (SELECT host, line, count(*) AS c FROM l GROUP BY host, line HAVING count(*) >= {lines.MIN_PAGES}) l JOIN t ON l.host = t.host
  WHERE l.c / t.n > {lines.MAX_RATIO} GROUP BY l.host),
k AS (
  SELECT p.page_id, p.host, p.ls, CASE WHEN b.bad IS NULL THEN p.ls ELSE list_filter(p.ls, lambda x: NOT list_contains(b.bad, x)) END AS kept
  FROM p LEFT JOIN b ON p.host = b.host)
SELECT page_id, host, array_to_string(kept, chr(10)) AS text, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(kept) AS BIGINT) AS n_dropped FROM k
"""

OP3 = f"""
WITH d AS (
  SELECT doc_id, source, md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord,
         CAST(coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, {mixing.MAX_EPOCHS} * source_size AS cap,
         list_element([{', '.join(map(str, mixing.WEIGHTS))}], CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1 AS BIGINT)) AS weight
  FROM s),
f AS (
  SELECT *, {mixing.SHARE[0]} * sum(source_size) OVER () - {mixing.SHARE[1]} * coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight
  FROM r WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST)),
g AS (SELECT *, cap * rest_weight * {mixing.SHARE[1]} <= left_over * weight AS is_full, cap / weight AS fill FROM f),
v AS (SELECT left_over, rest_weight FROM g WHERE NOT is_full ORDER BY fill, source ASC NULLS LAST LIMIT 1),
t AS (
  SELECT g.source, g.source_size,
         CASE WHEN g.is_full THEN CAST(g.cap AS DOUBLE)
              ELSE CAST(g.weight * (SELECT left_over FROM v) AS DOUBLE) / CAST((SELECT rest_weight FROM v) * {mixing.SHARE[1]} AS DOUBLE) END AS target
  FROM g),
c AS (
  SELECT d.*, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * whole + least(size, greatest(0, floor(target - whole * source_size - CAST(before AS DOUBLE)))) AS BIGINT) AS taken
FROM c
"""

OP4 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 80 * (a.n + b.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, e.y FROM r JOIN e ON r.c = e.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, (SELECT count(*) FROM e WHERE e.x = w.doc_id) AS n_links
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = w.doc_id
"""

ORACLES = {"op1_line_dedup": OP1, "op3_source_mixing": OP3, "op4_ngram_jaccard_join": OP4}
