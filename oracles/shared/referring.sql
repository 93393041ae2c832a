shown AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, ordinal) AS n FROM chunks),
patterns AS (
  SELECT *,
    regexp_extract_all(' ' || text, '(?i)[^\p{L}\p{N}_]((?:Bộ\s+luật|Luật|Pháp\s+lệnh|Nghị\s+định|Nghị\s+quyết|Thông\s+tư\s+liên\s+tịch|Thông\s+tư|Quyết\s+định|Chỉ\s+thị|Kế\s+hoạch|Đề\s+án|Công\s+văn) [^.;\n()]{1,99}?)\s*\([0-9]{1,4}(?:/[0-9]{4})?/[A-ZĐ0-9-]{2,}(?:/[A-ZĐ0-9-]{2,})?\)', 1) AS bt,
    regexp_extract_all(' ' || text, '(?i)[^\p{L}\p{N}_](?:Bộ\s+luật|Luật|Pháp\s+lệnh|Nghị\s+định|Nghị\s+quyết|Thông\s+tư\s+liên\s+tịch|Thông\s+tư|Quyết\s+định|Chỉ\s+thị|Kế\s+hoạch|Đề\s+án|Công\s+văn) [^.;\n()]{1,99}?\s*\(([0-9]{1,4}(?:/[0-9]{4})?/[A-ZĐ0-9-]{2,}(?:/[A-ZĐ0-9-]{2,})?)\)', 1) AS bn,
    regexp_extract_all(' ' || text, '(?i)[^\p{L}\p{N}_]((?:Bộ\s+luật|Luật|Pháp\s+lệnh|Nghị\s+định|Nghị\s+quyết|Thông\s+tư\s+liên\s+tịch|Thông\s+tư|Quyết\s+định|Chỉ\s+thị|Kế\s+hoạch|Đề\s+án|Công\s+văn)\s*(?:số\s*)?[0-9]{1,4}(?:/[0-9]{4})?/[A-ZĐ0-9-]{2,}(?:/[A-ZĐ0-9-]{2,})?(?:\s+[^.;\n()]{0,80})?)', 1) AS nt,
    regexp_extract_all(' ' || text, '(?i)[^\p{L}\p{N}_](?:Bộ\s+luật|Luật|Pháp\s+lệnh|Nghị\s+định|Nghị\s+quyết|Thông\s+tư\s+liên\s+tịch|Thông\s+tư|Quyết\s+định|Chỉ\s+thị|Kế\s+hoạch|Đề\s+án|Công\s+văn)\s*(?:số\s*)?([0-9]{1,4}(?:/[0-9]{4})?/[A-ZĐ0-9-]{2,}(?:/[A-ZĐ0-9-]{2,})?)(?:\s+[^.;\n()]{0,80})?', 1) AS nn,
    regexp_extract_all(' ' || text, '[^\p{L}\p{N}_]((?:Bộ\s+luật|Luật)\s+[A-ZÀ-ỴĐ][^.;\n()]{2,80})', 1) AS lt
  FROM shown),
raw AS (
  SELECT doc_id, chunk_id, page, n, text, 1 AS kind, unnest(range(0, len(bt))) AS pos, unnest(bt) AS title, unnest(bn) AS number FROM patterns
  UNION ALL
  SELECT doc_id, chunk_id, page, n, text, 2, unnest(range(0, len(nt))), unnest(nt), unnest(nn) FROM patterns
  UNION ALL
  SELECT doc_id, chunk_id, page, n, text, 3, unnest(range(0, len(lt))), unnest(lt),
         unnest(list_transform(lt, lambda t: regexp_extract(t, '(?i)\b[0-9]{1,4}(?:/[0-9]{4})?/[A-ZĐ0-9-]{2,}(?:/[A-ZĐ0-9-]{2,})?'))) FROM patterns),
cleaned AS (
  SELECT doc_id, chunk_id, page, n, text, kind, pos, trim(number, ' .,:;()') AS number,
         CASE WHEN number = '' THEN trim(regexp_replace(title, '\s+', ' ', 'g'), ' .,:;()')
              ELSE trim(regexp_replace(replace(trim(regexp_replace(title, '\s+', ' ', 'g'), ' .,:;()'), number, ''), '(?i)(^|[^\p{L}\p{N}_])số\s*$', '\1'), ' .,:;()') END AS title
  FROM raw),
keyed_refs AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n, kind, pos) AS ord,
         array_to_string(regexp_extract_all(replace(lower(CASE WHEN number <> '' THEN number ELSE title END), 'ß', 'ss'), '[\p{L}\p{N}_\x{00C0}-\x{1EF9}/-]+'), ' ') AS key,
         array_to_string(regexp_extract_all(replace(lower(title), 'ß', 'ss'), '[\p{L}\p{N}_\x{00C0}-\x{1EF9}/-]+'), ' ') AS title_key
  FROM cleaned WHERE title <> ''),
first_refs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY ord) AS nth FROM keyed_refs) WHERE nth = 1),
kept_refs AS MATERIALIZED (
  SELECT doc_id, title, number, key, chunk_id, page, ord,
         CASE WHEN length(text) <= 700 THEN text ELSE rtrim(left(text, 697)) || '...' END AS context
  FROM first_refs f
  WHERE number <> '' OR NOT EXISTS (SELECT 1 FROM first_refs g WHERE g.doc_id = f.doc_id AND g.number <> '' AND g.title_key = f.title_key AND g.ord < f.ord))
