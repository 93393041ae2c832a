-- uses: statute excerpts tampering
WITH claims AS (
  SELECT doc_id, CASE WHEN doc_id % 10 IN (8, 9) THEN [] ELSE list_concat(['P1-D1', 'P1-D1', '', 'X', 'P1-D2', 'X'], list(chunk_id ORDER BY chunk_id)) END AS ids
  FROM chunks GROUP BY doc_id),
listed AS (SELECT doc_id, unnest(ids) AS id, unnest(range(0, len(ids))) AS pos FROM claims),
j AS (
  SELECT l.*, c.chunk_id IS NOT NULL AS known, c.ordinal < 2 OR l.doc_id % 2 = 0 AS seen,
         c.article IS DISTINCT FROM t.article AS moved,
         l.doc_id % 7 = 3 AND NOT starts_with(lower(c.text), 'x ') AS altered
  FROM listed l LEFT JOIN chunks c ON c.doc_id = l.doc_id AND c.chunk_id = l.id LEFT JOIN tampered t ON t.doc_id = l.doc_id AND t.chunk_id = l.id),
r AS (
  SELECT *, CASE WHEN id = '' THEN 'blank citation ID'
       WHEN known AND seen AND row_number() OVER (PARTITION BY doc_id, id ORDER BY pos) > 1 THEN 'duplicate citation ID: ' || id
       WHEN NOT known THEN 'unknown citation ID: ' || id WHEN NOT seen THEN 'citation not retrieved: ' || id
       WHEN moved THEN 'inconsistent citation metadata: ' || id WHEN altered THEN 'inconsistent citation excerpt: ' || id END AS reason FROM j)
SELECT c.doc_id AS answer_id, coalesce(string_agg(id, '|' ORDER BY pos) FILTER (id IS NOT NULL AND reason IS NULL), '') AS citation_ids,
       CASE WHEN c.doc_id % 10 = 9 THEN 'citation IDs must be a list' ELSE coalesce(string_agg(reason, '|' ORDER BY pos) FILTER (reason IS NOT NULL), '') END AS invalid_reasons,
       c.doc_id % 10 <> 9 AND count(reason) = 0 AS valid
FROM claims c LEFT JOIN r ON r.doc_id = c.doc_id GROUP BY c.doc_id
