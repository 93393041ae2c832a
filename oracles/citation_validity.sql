-- uses: statute excerpts tampering
WITH claims AS (
  SELECT doc_id, CASE WHEN doc_id % 10 IN (8, 9) THEN [] ELSE list_concat(['P1-D1', 'P1-D1', '', 'X', 'P1-D2', 'X'], list(chunk_id ORDER BY chunk_id)) END AS ids
  FROM chunks GROUP BY doc_id),
listed AS (SELECT doc_id, unnest(ids) AS id, unnest(range(0, len(ids))) AS pos FROM claims),
j AS (
  SELECT l.*, c.chunk_id IS NOT NULL AS known, c.article IS DISTINCT FROM t.article AS moved,
         l.doc_id % 7 = 3 AND NOT starts_with(lower(c.text), 'x ') AS altered
  FROM listed l LEFT JOIN chunks c ON c.doc_id = l.doc_id AND c.chunk_id = l.id LEFT JOIN tampered t ON t.doc_id = l.doc_id AND t.chunk_id = l.id),
r AS (
  SELECT doc_id, id <> '' AND known AND row_number() OVER (PARTITION BY doc_id, id ORDER BY pos) = 1 AND NOT moved AND NOT altered AS holds FROM j
  UNION ALL SELECT DISTINCT doc_id, false FROM chunks WHERE doc_id % 10 = 9)
SELECT doc_id, count(*) AS n_citations, count(*) FILTER (holds) AS n_valid,
       round(CAST(count(*) FILTER (holds) AS DOUBLE) / count(*), 6) AS validity, count(*) FILTER (holds) = count(*) AS all_valid
FROM r GROUP BY doc_id
