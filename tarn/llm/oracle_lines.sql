WITH p AS (SELECT row_number() OVER () AS page, page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '') AS host, {text} AS t FROM pages),
lines AS (SELECT page, host, i, trim(raw, {blank}) AS line
  FROM (SELECT page, host, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM p WHERE t IS NOT NULL)
  WHERE trim(raw, {blank}) <> ''),
totals AS (SELECT host, count(*) AS total FROM p WHERE host IS NOT NULL AND t IS NOT NULL GROUP BY host),
counts AS (SELECT host, line, count(DISTINCT page) AS n FROM lines WHERE host IS NOT NULL GROUP BY host, line),
common AS (SELECT host, line, true AS gone FROM counts JOIN totals USING (host) WHERE n >= 2 AND n > 0.1::DOUBLE * total),
cut AS (
  SELECT page, count(*) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone IS NULL) AS text
  FROM lines LEFT JOIN common USING (host, line) GROUP BY page)
SELECT page_id, host, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
  CASE WHEN t IS NOT NULL THEN coalesce(text, '') END AS text
FROM p LEFT JOIN cut USING (page)
