WITH w AS (SELECT conv_id AS doc_id, (turn + 1) * 2 - 1 AS page_number FROM conversations)
SELECT w.doc_id, w.page_number, CASE WHEN c.text IS NOT NULL THEN 'text' END AS kind, c.text,
       CASE WHEN c.text IS NULL THEN 'DOCUMENT_NOT_FOUND' END AS error_code
FROM w LEFT JOIN conversations c ON c.conv_id = w.doc_id AND c.turn + 1 = w.page_number
