-- uses: statute
WITH RECURSIVE costs AS MATERIALIZED (
  SELECT doc_id, chunk_id, length(text) + length(chunk_id) + 8 AS cost, row_number() OVER (PARTITION BY doc_id ORDER BY page, ordinal) AS n
  FROM chunks),
fold AS (
  SELECT doc_id, n, chunk_id, cost AS size, CAST(0 AS BIGINT) AS batch FROM costs WHERE n = 1
  UNION ALL
  SELECT c.doc_id, c.n, c.chunk_id, CASE WHEN f.size + c.cost > 2000 THEN c.cost ELSE f.size + c.cost END,
         CASE WHEN f.size + c.cost > 2000 THEN f.batch + 1 ELSE f.batch END
  FROM fold f JOIN costs c ON c.doc_id = f.doc_id AND c.n = f.n + 1),
batched AS (SELECT doc_id, batch, count(DISTINCT chunk_id) AS n FROM fold GROUP BY ALL),
results AS (
  SELECT doc_id, batch, CASE WHEN n % 7 IN (3, 5) THEN 0 ELSE least(6, n) END AS n_findings,
         CASE n % 7 WHEN 5 THEN 'LLM response is not valid JSON matching the requested schema.' WHEN 3 THEN 'findings out of bounds' END AS error
  FROM batched),
failures AS (
  SELECT d.doc_id FROM documents d LEFT JOIN results r ON r.doc_id = d.doc_id
  GROUP BY d.doc_id HAVING count(r.error) > 0 OR count(r.batch) = 0)
SELECT doc_id FROM failures
