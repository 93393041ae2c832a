-- uses: statute
WITH RECURSIVE law_questions AS (
  SELECT doc_id || '-' || n AS q_id, doc_id, q AS question
  FROM (SELECT doc_id, unnest(range(0, 6)) AS n, unnest([
      'Số hiệu của luật ' || array_to_string(w[1:3], ' ') || ' là gì?',
      ' SỐ HIỆU  của Luật ' || upper(array_to_string(w[1:3], ' ')) || ' là gì ',
      'Số hiệu của luật ' || array_to_string(w[1:3], ' ') || ' sửa đổi là gì?',
      'Số hiệu của nghị định ' || array_to_string(w[1:3], ' ') || ' là gì?',
      'Số hiệu của quy chế ' || array_to_string(w[1:3], ' ') || ' là gì?',
      'Số hiệu của luật ' || array_to_string(w[2:3], ' ') || ' là gì!']) AS q FROM source_docs)),
--shared identity
SELECT q_id, identifier, identity_chunk, refused FROM identity
