WITH w AS (SELECT DISTINCT conv_id AS doc_id, turn + 1 + conv_id % 3 AS page_number FROM conversations)
SELECT w.doc_id AS answer_id, count(*) AS n_pages, count(*) FILTER (c.conv_id IS NULL) AS n_failed
FROM w LEFT JOIN conversations c ON c.conv_id = w.doc_id AND c.turn + 1 = w.page_number GROUP BY 1
