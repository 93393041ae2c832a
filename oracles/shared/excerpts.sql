cited AS (
  SELECT doc_id, chunk_id, page, chapter, section, article, clause, point,
         CASE WHEN length(text) <= 220 THEN text
              ELSE regexp_replace(rtrim(substr(text, 1, 217)), ' [^ ]*$', '') || '...' END AS excerpt
  FROM chunks)
