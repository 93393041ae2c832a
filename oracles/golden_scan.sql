WITH r AS (
  SELECT doc_id, 'r' || doc_id // 2 AS id, ['qa','summary','term','suggested_question'][1 + doc_id % 4] AS kind,
         doc_id % 3 = 0 AS has_gold, doc_id % 5 <> 0 AS has_question, doc_id % 8 < 4 AS inside, doc_id % 3 = 1 AS has_section, doc_id % 3 = 1 AS has_term, text FROM documents)
SELECT doc_id, id, kind AS record_type, coalesce(CASE WHEN trim(coalesce(text, '')) = '' THEN 'records require id and expected_output' END, CASE
       WHEN kind = 'qa' AND NOT has_question THEN 'qa records require question, scope, and expected_out_of_scope'
       WHEN kind = 'qa' AND inside AND NOT has_gold THEN 'in-scope qa records require gold citations'
       WHEN kind = 'qa' AND NOT inside AND has_gold THEN 'out-of-scope qa records cannot have gold citations'
       WHEN kind = 'summary' AND NOT has_section THEN 'summary records require section'
       WHEN kind = 'term' AND NOT has_term THEN 'term records require term' END,
       CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'release dataset record IDs must be unique' END) AS error, md5(text) AS digest
FROM r
