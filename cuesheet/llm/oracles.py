"""DuckDB SQL for the queries that SQL can express, on the whole tables."""

ALNUM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
VISIBLE_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {ALNUM_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
pos AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
run AS (
  SELECT doc_id, i, [x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o, lead(x, 5) OVER o,
    lead(x, 6) OVER o, lead(x, 7) OVER o, lead(x, 8) OVER o, lead(x, 9) OVER o] AS ten
  FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)
),
hit AS (
  SELECT doc_id, i, n, item_id
  FROM (SELECT doc_id, i, n, array_to_string(ten[1:n], ' ') AS k FROM run, (SELECT DISTINCT n FROM win) WHERE ten[n] IS NOT NULL)
  JOIN win USING (n, k)
),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

MIX = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce('0' || source, '1') AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
),
src AS (
  SELECT key, source_size, [1, 2, 3][(row_number() OVER (ORDER BY key) - 1) % 3 + 1] AS weight, source_size * 3 AS cap
  FROM (SELECT key, sum(size)::BIGINT AS source_size FROM sized GROUP BY key)
),
level AS (
  SELECT 0 AS step, sum(source_size)::DOUBLE / sum(weight)::DOUBLE AS x FROM src
  UNION
  SELECT step + 1, y FROM (
    SELECT step, x, ((SELECT sum(source_size) FROM src) - (SELECT coalesce(sum(cap), 0) FROM src WHERE cap < x * weight))::DOUBLE
      / (SELECT sum(weight) FROM src WHERE NOT cap < x * weight)::DOUBLE AS y
    FROM level
  ) WHERE y > x
),
aim AS (
  SELECT key, source_size, least(cap::DOUBLE, (SELECT max(x) FROM level) * weight) AS target,
    CASE WHEN source_size > 0 THEN greatest(1, floor(source_size / 64 + 0.5)) ELSE 0 END::BIGINT AS blocks
  FROM src
),
unit AS (
  SELECT *, CASE WHEN blocks > 0 THEN floor(target * blocks / source_size * 1048576 + 0.5) ELSE 0 END::BIGINT AS units FROM aim
),
cum AS (SELECT *, (sum(units) OVER (ORDER BY key) - units)::BIGINT AS lo FROM unit),
total AS (SELECT sum(units)::BIGINT AS u FROM unit),
slot AS (
  SELECT t, least(floor((z - floor(z)) * u::DOUBLE)::BIGINT, u - 1) AS point
  FROM (SELECT t, u, (t % 1048576) * 0.6180339887498949::DOUBLE + (t // 1048576) * 0.607787409740351::DOUBLE AS z
        FROM (SELECT u, unnest(range((u + 524288) // 1048576)) AS t FROM total))
),
ranked AS (
  SELECT key, blocks, row_number() OVER (PARTITION BY key ORDER BY t) - 1 AS r
  FROM slot JOIN cum ON point >= lo AND point < lo + units
),
times AS (SELECT key, r % blocks AS block, count(*) AS times FROM ranked WHERE r < blocks * 3 GROUP BY 1, 2),
stream AS (
  SELECT key, doc_id, size, (sum(size) OVER (PARTITION BY key ORDER BY md5(coalesce(doc_id::VARCHAR, 'null')), doc_id, size) - size)::BIGINT AS start
  FROM sized WHERE size > 0
),
shape AS (SELECT key, blocks, source_size // blocks AS q, source_size % blocks AS r FROM aim WHERE blocks > 0),
cut AS (
  SELECT key, doc_id, size, start, q, r, unnest(range(b0, b1 + 1)) AS block
  FROM (SELECT *, CASE WHEN start < r * (q + 1) THEN start // (q + 1) ELSE r + (start - r * (q + 1)) // greatest(q, 1) END AS b0,
      CASE WHEN start + size - 1 < r * (q + 1) THEN (start + size - 1) // (q + 1) ELSE r + (start + size - 1 - r * (q + 1)) // greatest(q, 1) END AS b1
    FROM stream JOIN shape USING (key))
),
taken AS (
  SELECT key, doc_id, sum((least(start + size, (block + 1) * q + least(block + 1, r)) - greatest(start, block * q + least(block, r))) * coalesce(times, 0)) AS taken
  FROM cut LEFT JOIN times USING (key, block) GROUP BY key, doc_id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM sized JOIN aim USING (key) LEFT JOIN taken USING (key, doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {VISIBLE_WORDS} AS w FROM documents),
pos AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
run AS (
  SELECT doc_id, n, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS k
  FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)
),
s AS (SELECT DISTINCT doc_id, k FROM run WHERE i <= greatest(n - 4, 1)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN size m ON m.doc_id = p.a JOIN size n ON n.doc_id = p.b
  WHERE 100 * c >= 75 * (m.n + n.n - c)
),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN size USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

PARAGRAPHS = r"""
WITH RECURSIVE lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents
),
d AS (
  SELECT * FROM (SELECT doc_id, place, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM lines)
  WHERE len(w) >= 20
),
pos AS (SELECT doc_id, place, len(w) AS n, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
run AS (
  SELECT doc_id, place, n, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS k
  FROM pos WINDOW o AS (PARTITION BY doc_id, place ORDER BY i)
),
sets AS (SELECT doc_id, place, list_sort(list_distinct(list(k))) AS s FROM run WHERE i <= n - 4 GROUP BY doc_id, place),
class AS (SELECT s, row_number() OVER () AS c, len(s) AS n FROM (SELECT DISTINCT s FROM sets)),
el AS (SELECT c, n, unnest(s) AS k FROM class),
link AS (
  SELECT a, b FROM (SELECT x.c AS a, y.c AS b, x.n AS na, y.n AS nb, count(*) AS shared FROM el x JOIN el y ON x.k = y.k AND x.c <> y.c GROUP BY ALL)
  WHERE 100 * shared >= 75 * (na + nb - shared)
),
reach AS (SELECT c AS a, c AS b FROM class UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
comp AS (SELECT a AS c, min(b) AS m FROM reach GROUP BY a),
gone AS (
  SELECT doc_id, place FROM (
    SELECT doc_id, place, row_number() OVER (PARTITION BY m ORDER BY doc_id, place) AS r FROM sets JOIN class USING (s) JOIN comp USING (c)
  ) WHERE r > 1
),
cut AS (SELECT doc_id, count(*) AS n_removed, string_agg(place::VARCHAR, ',' ORDER BY place) AS removed FROM gone GROUP BY doc_id),
rest AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY place) AS t FROM lines ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_paragraphs,
  coalesce(n_removed, 0)::BIGINT AS n_removed, removed, CASE WHEN text IS NOT NULL THEN coalesce(t, '') END AS text
FROM documents LEFT JOIN cut USING (doc_id) LEFT JOIN rest USING (doc_id)
"""

PASSAGES = r"""
WITH d AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS t,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
win AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 51], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(len(w) - 50)) AS i FROM d WHERE len(w) > 50)
),
held AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k HAVING count(DISTINCT doc_id) > 1),
word AS (
  SELECT doc_id, i, bool_or(first <> doc_id) AS gone
  FROM (SELECT doc_id, first, unnest(range(i, i + 51)) AS i FROM win JOIN held USING (k)) GROUP BY doc_id, i
),
runs AS (
  SELECT doc_id, kind, min(i) AS a, max(i) + 1 AS b FROM (
    SELECT doc_id, kind, i, i - row_number() OVER (PARTITION BY doc_id, kind ORDER BY i) AS g
    FROM (SELECT doc_id, 0 AS kind, i FROM word UNION ALL SELECT doc_id, 1, i FROM word WHERE gone)
  ) GROUP BY doc_id, kind, g
),
said AS (
  SELECT doc_id, sum(b - a) FILTER (kind = 0) AS n_repeated, sum(b - a) FILTER (kind = 1) AS n_removed,
    string_agg(a || '-' || b, ',' ORDER BY a) FILTER (kind = 0) AS repeated, string_agg(a || '-' || b, ',' ORDER BY a) FILTER (kind = 1) AS removed
  FROM runs GROUP BY doc_id
),
rest AS (
  SELECT doc_id, string_agg(x, '' ORDER BY i) AS t FROM (SELECT doc_id, unnest(t) AS x, unnest(range(len(t))) AS i FROM d)
  ANTI JOIN (SELECT doc_id, i FROM word WHERE gone) USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_repeated, 0)::BIGINT AS n_repeated, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(repeated, '') AS repeated, coalesce(removed, '') AS removed,
  CASE WHEN text IS NOT NULL THEN regexp_extract(text, '^[\x20\x09-\x0D]*') || coalesce(rest.t, '') END AS text
FROM d LEFT JOIN said USING (doc_id) LEFT JOIN rest USING (doc_id)
"""
