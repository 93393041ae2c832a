WITH w AS (SELECT page_id, url, regexp_extract_all(html, '[a-z]{4,}') AS w FROM pages),
h AS (
  SELECT page_id, w, ' ' || array_to_string(regexp_extract_all(lower('Văn bản ' || CASE WHEN page_id % 2 = 0 THEN array_to_string(w[2:], ' ')
         ELSE 'số ' || page_id || '/2020/qh14' END || ' ' || url), '[\p{L}\p{N}_\x{00C0}-\x{1EF9}/-]+'), ' ') || ' ' AS hay FROM w),
t AS (SELECT *, list_distinct(list_concat(['luật'], w[1:2])) AS tw FROM h)
SELECT page_id, (page_id % 3 = 0 AND contains(hay, page_id || '/2020/qh14'))
       OR len(list_filter(tw, lambda x: contains(hay, ' ' || x || ' '))) >= least(2, len(tw)) AS relevant
FROM t
