WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM met JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 5 * k >= 4 * (a.n + b.n - k)
  UNION ALL SELECT a.doc_id, b.doc_id FROM w a JOIN w b ON len(a.w) = 0 AND len(b.w) = 0 AND a.doc_id <> b.doc_id),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
lowest AS (SELECT u, min(v) AS v FROM reach GROUP BY u),
many AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT d.doc_id, CAST(least(d.doc_id, coalesce(l.v, d.doc_id)) AS BIGINT) AS class_id, CAST(coalesce(m.n, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN lowest l ON l.u = d.doc_id LEFT JOIN many m ON m.u = d.doc_id
