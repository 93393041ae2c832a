-- uses: statute raised
WITH held AS (SELECT doc_id, list(chunk_id) AS have, max(page) AS pages FROM chunks GROUP BY 1),
k AS (
  SELECT doc_id, list_filter(CASE WHEN 'P' || pages || '-D1' IN ('P2-D1', 'P1-D1') THEN ['P2-D1', 'P1-D1', 'P9-D9', 'P1-D2', 'P1-D3', 'P2-D2']
           ELSE ['P2-D1', 'P1-D1', 'P9-D9', 'P1-D2', 'P1-D3', 'P2-D2', 'P' || pages || '-D1'] END, lambda x: list_contains(have, x)) AS known,
         list_filter(CASE WHEN 'P' || pages || '-D1' IN ('P2-D1', 'P1-D1') THEN ['P2-D1', 'P1-D1', 'P1-D3', 'P2-D2']
           ELSE ['P2-D1', 'P1-D1', 'P1-D3', 'P2-D2', 'P' || pages || '-D1'] END, lambda x: list_contains(have, x)) AS section FROM held),
q AS (SELECT doc_id, string_agg(CASE kind WHEN 1 THEN 'Chủ thể nào có nghĩa vụ hoặc trách nhiệm theo quy định này?' ELSE 'Điều kiện, thủ tục hoặc thời hạn áp dụng quy định là gì?' END, '|' ORDER BY nth) AS first_two FROM raised WHERE nth <= 2 GROUP BY 1)
SELECT doc_id, array_to_string(known, '|') AS known, array_to_string(known[1:3], '|') AS visible, len(known) > 3 AS has_more,
       array_to_string(list_sort(list_distinct(list_transform(known, lambda x: CAST(regexp_extract(x, '[0-9]+') AS INTEGER)))), ',') AS pages,
       array_to_string(section, '|') AS section_ids, coalesce(first_two, '') AS first_two
FROM k LEFT JOIN q USING (doc_id)
