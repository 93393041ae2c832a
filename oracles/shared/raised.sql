raised AS (
  SELECT doc_id, chunk_id, kind, row_number() OVER (PARTITION BY doc_id ORDER BY page, ordinal, kind) AS nth FROM (
    SELECT doc_id, chunk_id, page, ordinal, 1 AS kind FROM chunks WHERE regexp_matches(lower(text), 'có nghĩa vụ|chịu trách nhiệm|không được')
    UNION ALL
    SELECT doc_id, chunk_id, page, ordinal, 2 FROM chunks WHERE regexp_matches(lower(text), 'điều kiện|thủ tục|trình tự|thời hạn')))
