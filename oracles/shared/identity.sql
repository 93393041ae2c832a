asked_law AS (
  SELECT q_id, doc_id, replace(lower(question), 'ß', 'ss') AS ql,
         regexp_extract(replace(lower(question), 'ß', 'ss'), '^\s*số hiệu\s+của\s+(.+?)\s+là\s+gì\s*[?!.]?\s*$', 1) AS entity
  FROM law_questions),
kinds AS (
  SELECT q_id, doc_id, CASE
      WHEN entity = '' THEN 'other'
      WHEN regexp_matches(entity, '^(quyết định|nghị định|nghị quyết|thông tư|bộ luật|pháp lệnh)') THEN 'other'
      WHEN NOT starts_with(entity, 'luật ') OR len(regexp_extract_all(entity, '[\p{L}\p{N}_]+')) < 2 THEN 'refuse'
      WHEN regexp_matches(ql, '(^|[^\p{L}\p{N}_])(cũ|cựu|hết hiệu lực|bãi bỏ|thay thế|thay đổi|sửa đổi|bổ sung|đã bị|bị)([^\p{L}\p{N}_]|$)') THEN 'other'
      ELSE 'law' END AS kind,
      array_to_string(regexp_extract_all(entity, '[\p{L}\p{N}_]+'), ' ') AS title
  FROM asked_law),
declared AS (
  SELECT doc_id, page, chunk_id, regexp_extract(text, '(?i)luật số: ([0-9]{1,5}/[0-9]{4}/[A-ZĐ0-9-]+)', 1) AS identifier,
         array_to_string(regexp_extract_all(lower(regexp_extract(text, 'QH14 (LUẬT .+?) Căn cứ', 1)), '[\p{L}\p{N}_]+'), ' ') AS title
  FROM chunks c
  WHERE page = (SELECT min(page) FROM chunks m WHERE m.doc_id = c.doc_id)
    AND article IS NULL AND clause IS NULL AND point IS NULL
    AND regexp_matches(text, '(?i)luật số: [0-9]{1,5}/[0-9]{4}/[A-ZĐ0-9-]+')),
named AS (
  SELECT q_id, CASE WHEN count(DISTINCT identifier) = 1 THEN arg_min(identifier, (page, chunk_id)) END AS identifier,
         CASE WHEN count(DISTINCT identifier) = 1 THEN arg_min(chunk_id, (page, chunk_id)) END AS identity_chunk,
         count(DISTINCT identifier) > 1 AS refused
  FROM kinds k JOIN declared d ON d.doc_id = k.doc_id AND d.title = k.title
  WHERE kind = 'law' AND k.title <> '' GROUP BY 1),
identity AS (
  SELECT q_id, NULL::VARCHAR AS identifier, NULL::VARCHAR AS identity_chunk, true AS refused FROM kinds WHERE kind = 'refuse'
  UNION ALL SELECT * FROM named)
