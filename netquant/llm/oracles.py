"""SQL that gives the rows of the operators that SQL can express."""

from __future__ import annotations

HARD_NEGATIVES = """
WITH q AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS lab,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS (SELECT id, lab, generate_subscripts(v, 1) AS c, unnest(v) AS x FROM q),
anchors AS (SELECT * FROM cells WHERE id % 50 = 0),
scores AS (
  SELECT a.id AS anchor, a.lab AS anchor_lab, b.id, b.lab, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM anchors a JOIN cells b ON a.c = b.c AND a.id <> b.id GROUP BY ALL),
positive AS (
  SELECT anchor, id, score FROM scores WHERE lab = anchor_lab
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
negative AS (
  SELECT p.anchor, p.id AS positive, p.score AS positive_score, n.id, n.score,
    row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS place
  FROM positive p JOIN scores n ON n.anchor = p.anchor AND n.lab <> n.anchor_lab
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(place AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM negative WHERE place <= 3
"""

COLLOCATIONS = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS g
  FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS size)),
f AS (SELECT lang, size, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
parts AS (SELECT lang, size, g, f, string_split(g, ' ') AS w FROM f WHERE size > 1),
inner_parts AS (
  SELECT lang, f, unnest(list_transform(range(1, size - len + 2), lambda i: array_to_string(w[i : i + len - 1], ' '))) AS g
  FROM parts, (SELECT unnest([2, 3, 4]) AS len) WHERE len < size),
covered AS (SELECT lang, g, max(f) AS longer FROM inner_parts GROUP BY ALL),
cuts AS (
  SELECT p.lang, p.g, p.f AS a, k, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 : size], ' ') AS y
  FROM parts p LEFT JOIN covered c ON c.lang = p.lang AND c.g = p.g, (SELECT unnest([1, 2, 3, 4]) AS k)
  WHERE k < size AND coalesce(c.longer, 0) < p.f),
scored AS (
  SELECT c.lang, c.g, c.a, k, l.f AS l, r.f AS r, n, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.g = c.x JOIN f r ON r.lang = c.lang AND r.g = c.y JOIN totals t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.g ORDER BY score, k) = 1)
SELECT lang, rank, g AS phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM scored) WHERE rank <= 2000
"""

ARCHIVED_PAGES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
top AS (SELECT page_id, n, sha1(html) AS d, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < first THEN first END AS refers_to
FROM top
"""
