found AS (
  SELECT doc_id, page, ordinal, page * 1000 + ordinal AS pos,
         CASE WHEN (page + ordinal + doc_id) % 9 = 0 THEN '' ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END AS text,
         CASE WHEN (page + ordinal + doc_id) % 2 = 0 THEN 'risk' ELSE 'context' END AS kind,
         CASE WHEN (page + ordinal + doc_id) % 5 = 0 THEN '' ELSE chunk_id END AS citation_ids FROM chunks)
