-- uses: statute excerpts
WITH claims AS (
  SELECT doc_id, CASE WHEN doc_id % 10 IN (8, 9) THEN [] ELSE list_concat(['P1-D1', 'P1-D1', '', 'X', 'P1-D2', 'X'], list(chunk_id ORDER BY chunk_id)) END AS ids
  FROM chunks GROUP BY doc_id),
listed AS (SELECT doc_id, unnest(ids) AS id, unnest(range(0, len(ids))) AS pos FROM claims)
SELECT l.doc_id AS answer_id, min(pos) AS pos, c.chunk_id AS citation_id, c.page, c.chapter, c.article, c.clause,
       CASE WHEN (l.doc_id + c.page) % 2 = 0 THEN e.excerpt ELSE c.text END AS excerpt
FROM listed l JOIN chunks c ON c.doc_id = l.doc_id AND c.chunk_id = l.id JOIN cited e ON e.doc_id = c.doc_id AND e.chunk_id = c.chunk_id
GROUP BY ALL
