tampered AS (
  SELECT doc_id, chunk_id, page, chapter, clause, CASE WHEN doc_id % 11 = 5 THEN 'Điều 0' ELSE article END AS article,
         CASE WHEN doc_id % 7 = 3 THEN 'x ' || excerpt ELSE excerpt END AS excerpt FROM cited)
