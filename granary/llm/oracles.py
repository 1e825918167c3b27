"""SQL for the corpus queries that SQL can express."""

from __future__ import annotations

JACCARD = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM t WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT p.a, p.b
  FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * c >= 80 * (na.n + nb.n - c)
), reach(a, b) AS (
  SELECT a, b FROM links
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(t.doc_id, coalesce(r.b, t.doc_id)) AS component_id
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON r.a = t.doc_id
"""

REPEATS = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), p AS (
  SELECT doc_id, b, unnest(generate_series(1, octet_length(b))) AS p FROM d WHERE octet_length(b) > 0
), w AS (
  SELECT doc_id, p, hex(array_slice(b, p, p)) AS byte, CASE WHEN p + 399 <= octet_length(b) THEN hash(array_slice(b, p, p + 399)) END AS k FROM p
), c AS (
  SELECT doc_id, p, byte, CASE WHEN k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 THEN p END AS hit FROM w
), g AS (
  SELECT doc_id, p, byte, coalesce(p - max(hit) OVER (PARTITION BY doc_id ORDER BY p) < 400, false) AS gone FROM c
), e AS (
  SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY p) AS new FROM g
), r AS (
  SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (new) AS n_spans,
    sha256(unhex(coalesce(string_agg(byte, '' ORDER BY p) FILTER (NOT gone), ''))) AS kept_sha256
  FROM e GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256(''::BLOB)) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

SQL = {"op5_ngram_jaccard_join": JACCARD, "op6_suffix_dedup": REPEATS}
