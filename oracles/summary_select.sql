-- uses: statute summaries
SELECT doc_id, section, chunk_id, CASE WHEN length(text) <= 700 THEN text ELSE rtrim(left(text, 697)) || '...' END AS text
FROM picks
