leading_refs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS nth FROM kept_refs) WHERE nth <= 5),
results AS (
  SELECT page_id, url, '"' || CASE WHEN page_id % 3 = 0 THEN 'Luật An ninh mạng ' || (10 + page_id % 7) || '/2018/QH14'
           ELSE 'Nghị định số  về dữ liệu ' || (1 + page_id % 40) || '/2023/NĐ-CP' END || '" văn bản quy định chính thức' AS query,
         CASE WHEN page_id % 4 = 0 THEN 'Tin khác' WHEN page_id % 3 = 0 THEN 'Văn bản ' || (10 + page_id % 7) || '/2018/QH14'
              ELSE 'Văn bản ' || (1 + page_id % 40) || '/2023/NĐ-CP' END AS found_title,
         CASE WHEN page_id % 5 = 0 THEN '' ELSE trim(html) END AS content, (page_id % 10) / 10.0 AS score
  FROM pages WHERE regexp_matches(lower(url), '^https?://([^/?#]*\.)?example\.com([:/?#]|$)')),
fitting AS (
  SELECT l.doc_id, l.nth, r.url, r.content, row_number() OVER (PARTITION BY l.doc_id, l.nth ORDER BY score DESC, page_id) AS best
  FROM leading_refs l JOIN results r ON r.query = '"' || CASE WHEN number <> '' THEN title || ' ' || number ELSE title END || '" văn bản quy định chính thức'
  WHERE (number <> '' AND contains(' ' || array_to_string(regexp_extract_all(lower(found_title || ' ' || content || ' ' || url), '[\p{L}\p{N}_\x{00C0}-\x{1EF9}/-]+'), ' '), lower(number)))
     OR len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(title), '[\p{L}\p{N}_\x{00C0}-\x{1EF9}/-]+'), lambda w: length(w) >= 4)),
            list_distinct(regexp_extract_all(lower(found_title || ' ' || content || ' ' || url), '[\p{L}\p{N}_\x{00C0}-\x{1EF9}/-]+'))))
        >= least(2, len(list_distinct(list_filter(regexp_extract_all(lower(title), '[\p{L}\p{N}_\x{00C0}-\x{1EF9}/-]+'), lambda w: length(w) >= 4))))),
related AS (
  SELECT l.doc_id, l.nth, l.title, l.number AS document_number, l.page, l.chunk_id, f.url,
         lower(regexp_extract(f.url, '^https?://([^/:?#]*)', 1)) AS host,
         CASE WHEN f.url IS NULL THEN l.context ELSE
           CASE WHEN length(trim(regexp_replace(CASE WHEN f.content <> '' THEN f.content ELSE l.context END, '\s+', ' ', 'g'))) <= 900
                THEN trim(regexp_replace(CASE WHEN f.content <> '' THEN f.content ELSE l.context END, '\s+', ' ', 'g'))
                ELSE rtrim(left(trim(regexp_replace(CASE WHEN f.content <> '' THEN f.content ELSE l.context END, '\s+', ' ', 'g')), 897)) || '...' END END AS excerpt
  FROM leading_refs l LEFT JOIN (SELECT * FROM fitting WHERE best = 1) f ON f.doc_id = l.doc_id AND f.nth = l.nth)
