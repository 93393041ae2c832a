WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id,
       CASE WHEN length(t) <= 220 THEN t ELSE regexp_replace(rtrim(left(t, 217)), ' [^ ]*$', '') || '...' END AS excerpt,
       CASE WHEN length(t) <= 700 THEN t ELSE rtrim(left(t, 697)) || '...' END AS summary,
       CASE WHEN length(t) <= 900 THEN t ELSE rtrim(left(t, 897)) || '...' END AS related
FROM c
