ordered AS (
  SELECT doc_id, chunk_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY page, ordinal) AS n,
         regexp_matches(lower(text), 'căn cứ|phạm vi|điều') AS f1, regexp_matches(lower(text), 'quy định|nghĩa vụ|quyền') AS f2,
         regexp_matches(lower(text), 'phê duyệt|quyết định|trách nhiệm|thẩm quyền') AS f3,
         regexp_matches(lower(text), 'xử phạt|rủi ro|hiệu lực|vi phạm') AS f4 FROM chunks),
pick1 AS (SELECT doc_id, coalesce(min(n) FILTER (f1), min(n)) AS n1 FROM ordered GROUP BY 1),
pick2 AS (
  SELECT o.doc_id, any_value(n1) AS n1, coalesce(min(n) FILTER (f2 AND n <> n1), min(n) FILTER (n <> n1), min(n)) AS n2
  FROM ordered o JOIN pick1 p ON p.doc_id = o.doc_id GROUP BY 1),
pick3 AS (
  SELECT o.doc_id, any_value(n1) AS n1, any_value(n2) AS n2,
         coalesce(min(n) FILTER (f3 AND n NOT IN (n1, n2)), min(n) FILTER (n NOT IN (n1, n2)), min(n)) AS n3
  FROM ordered o JOIN pick2 p ON p.doc_id = o.doc_id GROUP BY 1),
pick4 AS (
  SELECT o.doc_id, any_value(n1) AS n1, any_value(n2) AS n2, any_value(n3) AS n3,
         coalesce(min(n) FILTER (f4 AND n NOT IN (n1, n2, n3)), min(n) FILTER (n NOT IN (n1, n2, n3)), min(n)) AS n4
  FROM ordered o JOIN pick3 p ON p.doc_id = o.doc_id GROUP BY 1),
chosen AS (
  SELECT doc_id, 'context' AS section, n1 AS n FROM pick4 UNION ALL SELECT doc_id, 'main_content', n2 FROM pick4
  UNION ALL SELECT doc_id, 'decision_points', n3 FROM pick4 UNION ALL SELECT doc_id, 'impact', n4 FROM pick4),
picks AS (SELECT c.doc_id, section, chunk_id, text FROM chosen c JOIN ordered o ON o.doc_id = c.doc_id AND o.n = c.n)
