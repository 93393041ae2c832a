WITH w AS (SELECT doc_id, regexp_extract_all(text, '[a-z]{4,}') AS w FROM documents),
c AS (
  SELECT doc_id, ['defined-term','Legal Subject','thủ tục hành chính','Chế tài','nhãn khác','Nghĩa vụ','khái niệm được hiểu'][1 + doc_id % 7] AS label,
         ['điều kiện','người lao động','xử phạt','quyền','định nghĩa',''][1 + (doc_id // 7) % 6] AS proof FROM w)
SELECT doc_id, CASE label WHEN 'defined-term' THEN 'defined_term' WHEN 'Legal Subject' THEN 'legal_subject'
         WHEN 'thủ tục hành chính' THEN 'procedure_condition' WHEN 'Chế tài' THEN 'sanction_dispute'
         WHEN 'Nghĩa vụ' THEN 'right_obligation' WHEN 'khái niệm được hiểu' THEN 'defined_term'
         ELSE CASE proof WHEN 'điều kiện' THEN 'procedure_condition' WHEN 'người lao động' THEN 'legal_subject'
              WHEN 'xử phạt' THEN 'sanction_dispute' WHEN 'quyền' THEN 'right_obligation' WHEN 'định nghĩa' THEN 'defined_term'
              ELSE 'technical_concept' END END AS category
FROM c
