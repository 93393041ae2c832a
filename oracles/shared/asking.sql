questions AS (
  SELECT doc_id AS q_id, doc_id, CASE doc_id % 6
      WHEN 0 THEN 'Điều ' || (1 + doc_id % 7) || ' quy định gì về ' || array_to_string(w[1:4], ' ')
      WHEN 1 THEN 'Thời hạn của ' || array_to_string(w[1:5], ' ') || ' là khi nào?'
      WHEN 2 THEN 'Số hiệu của luật ' || array_to_string(w[1:3], ' ') || ' là gì?'
      WHEN 3 THEN 'Kinh phí của ' || array_to_string(w[3:8], ' ') || ' là bao nhiêu tiền?'
      WHEN 4 THEN 'là và của cho'
      ELSE 'Cơ quan nào phụ trách ' || array_to_string(w[2:6], ' ') || '?' END AS question
  FROM source_docs),
q_words AS (
  SELECT q_id, doc_id, question,
         list_distinct(regexp_extract_all(replace(lower(question), 'ß', 'ss'), '[\p{L}\p{N}_\x{00C0}-\x{1EF9}]{2,}')) AS qt
  FROM questions)
