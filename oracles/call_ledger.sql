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
batched AS (SELECT doc_id, batch, count(DISTINCT chunk_id) AS n FROM fold GROUP BY ALL)
SELECT doc_id, batch, CASE WHEN n % 7 IN (3, 5) THEN CAST(2 AS BIGINT) ELSE 1 END AS attempts,
       CASE n % 7 WHEN 1 THEN 'timeout' WHEN 6 THEN 'http' WHEN 2 THEN 'transport' WHEN 3 THEN 'output' ELSE 'ok' END AS code,
       CASE WHEN n % 7 IN (0, 4, 5) THEN least(6, n) ELSE 0 END AS n_findings,
       CASE n % 7 WHEN 1 THEN 'LLM request timed out.' WHEN 6 THEN 'LLM request failed with HTTP 503. overloaded'
            WHEN 2 THEN 'LLM request failed before a valid response was received.' WHEN 3 THEN 'findings out of bounds' END AS error
FROM batched
