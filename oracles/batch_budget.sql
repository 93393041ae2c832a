-- uses: statute
WITH RECURSIVE costs AS MATERIALIZED (
  SELECT doc_id, chunk_id, length(text) + length(chunk_id) + 8 AS cost, row_number() OVER (PARTITION BY doc_id ORDER BY page, ordinal) AS n
  FROM chunks),
fold AS (
  SELECT doc_id, n, chunk_id, cost, cost AS size, CAST(0 AS BIGINT) AS batch FROM costs WHERE n = 1
  UNION ALL
  SELECT c.doc_id, c.n, c.chunk_id, c.cost, CASE WHEN f.size + c.cost > 2000 THEN c.cost ELSE f.size + c.cost END,
         CASE WHEN f.size + c.cost > 2000 THEN f.batch + 1 ELSE f.batch END
  FROM fold f JOIN costs c ON c.doc_id = f.doc_id AND c.n = f.n + 1)
SELECT doc_id, chunk_id, cost, batch FROM fold
