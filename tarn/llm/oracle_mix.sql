WITH numbers AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    coalesce(CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>!]+', '', 'g')) AS DOUBLE) / nullif(length(text), 0), 0.0::DOUBLE) AS share,
    (CAST(('0x' || substr(md5('9:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
classed AS (
  SELECT *, len(list_filter([0.0::DOUBLE, 0.001, 0.003, 0.01, 0.02, 0.04, 0.08, 0.16, 0.32], lambda c: c < share)) * 6
    + len(list_filter([10, 30, 100, 300, 1000], lambda c: c < size)) AS class
  FROM numbers),
told AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
learned AS (SELECT class, CAST(sum(good) AS DOUBLE) AS good, CAST(count(*) AS DOUBLE) AS n FROM classed JOIN told USING (doc_id) GROUP BY class),
average AS (SELECT sum(good) / sum(n) AS p FROM learned),
drawn AS (
  SELECT doc_id, source, size, -ln(u) / coalesce(greatest(0.05::DOUBLE, (coalesce(good, 0.0::DOUBLE) + 10.0::DOUBLE * p) / (coalesce(n, 0.0::DOUBLE) + 10.0::DOUBLE)), 1.0::DOUBLE) AS key
  FROM classed LEFT JOIN learned USING (class), average),
sources AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM drawn GROUP BY source),
capped AS (SELECT source, source_size, [3, 1, 2][CAST((place - 1) % 3 + 1 AS INT)] AS weight, CAST(source_size * 2.0 AS DOUBLE) AS cap FROM sources),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM capped),
targets AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM targets),
placed AS (
  SELECT d.doc_id, d.source, d.size, CAST(e.source_size AS BIGINT) AS source_size, e.target, CAST(e.epochs AS BIGINT) AS epochs,
    e.target - e.epochs * CAST(e.source_size AS DOUBLE) AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM drawn d JOIN epochs e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
