WITH r AS (
  SELECT doc_id, text,
         CASE WHEN doc_id % 6 = 4 THEN 'Model output was truncated by its token limit.'
              WHEN doc_id % 12 = 5 THEN 'Model refused the structured-output request.'
              WHEN doc_id % 6 IN (2, 3) THEN 'LLM response is not valid JSON matching the requested schema.' END AS error FROM documents)
SELECT doc_id, CASE WHEN error IS NULL THEN text END AS answer, CASE WHEN error IS NULL THEN doc_id END AS score, error FROM r
