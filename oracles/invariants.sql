-- uses: spoken
SELECT doc_id, chunk_id, 'chunk_id values must be unique' AS violation FROM spoken WHERE doc_id % 9 = 0 AND page = 2
UNION ALL
SELECT s.doc_id, chunk_id, 'chunk page cannot exceed page_count'
FROM (SELECT * FROM spoken UNION ALL SELECT * FROM spoken WHERE doc_id % 9 = 0 AND page = 2) s
JOIN (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY 1) c ON c.conv_id = s.doc_id
WHERE s.doc_id % 5 = 0 AND page > n - 1
UNION ALL
SELECT doc_id, 'P0-D0', 'citations keys must reference chunk_id values' FROM spoken WHERE doc_id % 4 = 0 AND page = 1
